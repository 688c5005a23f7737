"""Density clustering of vectors (hierarchical, with noise) for collections of any size.

The result is that of the published algorithm: mutual reachability, its minimum spanning tree, the condensed tree and the
excess of mass. Distances are exact, so their number stays quadratic in a scope; what a task holds does not:

- Rows are dealt into blocks, and two blocks meet in a cell, once. A matrix product tells which pairs may be among a row's nearest, those
  are computed exactly, and the lists of all cells are merged: each row's core distance and its few nearest rows.
- The spanning forest of the listed pairs, by Borůvka rounds: every component takes its least edge, components merge, edges within one
  vanish. Rounds grow with the logarithm of the rows. Few enough edges are ended by one task.
- A component's least listed edge is its least edge of all if no list of its rows ends before it. Components grow by such edges; all but a
  scope's largest that have none are searched: their rows of too short lists meet all rows in cells. Each search halves the components at least.
- n - 1 edges a scope remain; the components and the condensed tree are made of them in flat arrays, in one task a scope.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrade.operators.components import components, roots_of
from loomgrade.operators.skew import lookup
from loomgrade.session import materialise, ship

LEAST_CLUSTER = 3
CELL = 2_000  # rows of a side of a cell, up to WAYS blocks; more rows make larger blocks first
WAYS = 12
CELL_BYTES = 8 << 20  # vectors of a side of a cell, about, if there are more than WAYS blocks
MORE = 8  # rows that a list has beyond those of the core distance
TILE = (1_024, 2_048)  # pairs that are looked at together
HELD = 2_000_000  # pairs that wait for their exact distance
MERGED = 100_000  # lists that a task merges at once
FINISH = 1_000_000  # edges that one task may hold
SURE = 1e12  # the density of rows that are equal


def _matrix(table: pa.Table, name: str = "v") -> np.ndarray:
    v = table.column(name).combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)


def _far(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distances of a row to rows; the same bits whatever the other rows are, so that cells agree."""
    return np.sqrt(((x - row) ** 2).sum(axis=1))


def _pairs_far(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """`_far` of pairs of rows."""
    out = np.empty(len(p))
    for at in range(0, len(p), 20_000):
        out[at : at + 20_000] = _far(x[p[at : at + 20_000]], y[q[at : at + 20_000]])
    return out


def _tiles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Squared distances of rows of x and y by a matrix product, a tile at a time with its first row and column; off by `_slack` at most."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    for i in range(0, len(x), TILE[0]):
        left = -2 * x[i : i + TILE[0]]
        for j in range(0, len(y), TILE[1]):
            d = left @ y[j : j + TILE[1]].T
            d += xx[i : i + TILE[0], None]
            d += yy[None, j : j + TILE[1]]
            yield i, j, d


def _slack(x: np.ndarray, y: np.ndarray) -> float:
    most = sum(float(np.sqrt((z * z).sum(axis=1).max(initial=0.0))) for z in (x, y))
    return 8 * (x.shape[1] + 8) * np.finfo(float).eps * most * most


class _Lists:
    """The k nearest (distance, id) of each of n rows among pairs that come in any order."""

    def __init__(self, n: int, k: int):
        self.k, self.row, self.other, self.far = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.cap = np.full(n, np.inf)  # squared distance beyond which a row needs no more

    def add(self, row: np.ndarray, other: np.ndarray, far: np.ndarray, slack: float = 0.0) -> None:
        row, other, far = (np.concatenate(z) for z in ((self.row, row), (self.other, other), (self.far, far)))
        order = np.lexsort((other, far, row))
        row, other, far = row[order], other[order], far[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        last = nth == self.k - 1
        self.cap[row[last]] = np.minimum(self.cap[row[last]], far[last] ** 2 + slack)
        keep = nth < self.k
        self.row, self.other, self.far = row[keep], other[keep], far[keep]


def _nearest_in_cell(x: np.ndarray, y: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray, k: int, same: bool) -> tuple[_Lists, _Lists | None]:
    """Lists of the rows of x among y and, unless x and y are the same rows, of those of y among x."""
    slack = _slack(x, y)
    sides = [_Lists(len(x), k), None if same else _Lists(len(y), k)]
    waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def settle(side: int) -> None:
        if waiting[side]:
            p, q = (np.concatenate(z) for z in zip(*waiting[side], strict=True))
            waiting[side].clear()
            far = _pairs_far(x, p, y, q)
            sides[side].add(*((q, ids_x[p]) if side else (p, ids_y[q])), far, slack)

    for i, j, d in _tiles(x, y):
        if same and i < j + d.shape[1] and j < i + d.shape[0]:
            own = np.arange(max(i, j), min(i + d.shape[0], j + d.shape[1]))
            d[own - i, own - j] = np.inf
        for side, lists in enumerate(sides):
            if lists is None:
                continue
            cap = lists.cap[j : j + d.shape[1]] if side else lists.cap[i : i + d.shape[0]]
            axis, open_ = 1 - side, np.isinf(cap)
            if open_.any() and d.shape[axis] > k:
                nth = np.partition(d, k - 1, axis=axis).take(k - 1, axis=axis)
                cap[open_] = nth[open_] + 2 * slack
            p, q = np.divmod(np.flatnonzero((d <= (cap[None, :] if side else cap[:, None]) + slack).ravel()), d.shape[1])
            if same:
                apart = p + i != q + j
                p, q = p[apart], q[apart]
            waiting[side].append((p + i, q + j))
            if sum(len(z[0]) for z in waiting[side]) > HELD:
                settle(side)
    for side in (0, 1):
        settle(side)
    return sides[0], sides[1]


def _cells(rows: DataFrame) -> DataFrame:
    """Each row (scope, id, v, at, blocks) once for each cell (i, j) of its block; `left` tells the block of i."""
    left = rows.withColumn("j", F.explode(F.sequence(F.col("at"), F.col("blocks") - 1))).withColumn("i", F.col("at")).withColumn("left", F.lit(True))
    right = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("at")))).where("i <> at").withColumn("j", F.col("at")).withColumn("left", F.lit(False))
    return left.unionByName(right).drop("at", "blocks")


def _nearest(rows: DataFrame, least: int, buckets: int) -> DataFrame:
    """scope, id, core, ids, far: each row's nearest others by distance and id, and the distance to the least-th nearest row of the scope, the
    row itself being the first."""
    k = least - 1 + MORE

    def listed(ids: np.ndarray, lists: _Lists, scope: str) -> pa.Table:
        own, first = np.unique(lists.row, return_index=True)
        offsets = pa.array(np.append(first, len(lists.row)), pa.int32())
        return pa.table({"scope": pa.array([scope] * len(own), pa.string()), "id": pa.array(ids[own], pa.int64()), "ids": pa.ListArray.from_arrays(offsets, pa.array(lists.other, pa.int64())), "far": pa.ListArray.from_arrays(offsets, pa.array(lists.far, pa.float64()))})

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, ids, side = _matrix(table), table.column("id").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
        scope, same = key[0].as_py(), key[1].as_py() == key[2].as_py()
        a, b = np.flatnonzero(side), np.flatnonzero(side if same else ~side)
        one, two = _nearest_in_cell(x[a], x[b], ids[a], ids[b], k, same)
        return pa.concat_tables([listed(ids[s], found, scope) for s, found in ((a, one), (b, two)) if found is not None])

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, first, at = np.unique(table.column("id").to_numpy(), return_index=True, return_inverse=True)
        own, far = table.column("ids").combine_chunks(), table.column("far").combine_chunks()
        lists = _Lists(len(ids), k)
        lists.add(np.repeat(at, own.value_lengths().to_numpy(zero_copy_only=False)), own.flatten().to_numpy(), far.flatten().to_numpy())
        start = np.searchsorted(lists.row, np.arange(len(ids) + 1))
        nth = np.minimum(start[1:] - start[:-1], least - 1) - 1
        core = np.where(nth < 0, 0.0, lists.far[start[:-1] + np.maximum(nth, 0)])
        offsets = pa.array(start, pa.int32())
        return pa.table({"scope": table.column("scope").take(pa.array(first)).combine_chunks(), "id": pa.array(ids), "core": pa.array(core), "ids": pa.ListArray.from_arrays(offsets, pa.array(lists.other)), "far": pa.ListArray.from_arrays(offsets, pa.array(lists.far))})

    lists = _cells(rows).groupBy("scope", "i", "j").applyInArrow(meet, "scope string, id bigint, ids array<bigint>, far array<double>")
    lists = lists.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    return lists.groupBy("bucket").applyInArrow(merge, "scope string, id bigint, core double, ids array<bigint>, far array<double>")


def _listed_edges(near: DataFrame) -> DataFrame:
    """scope, a, b, w: the listed pairs with their mutual reachability, each once."""
    pairs = near.select("scope", "id", "core", F.explode(F.arrays_zip("ids", "far")).alias("p")).select("scope", "id", "core", F.col("p.ids").alias("other"), F.col("p.far").alias("far"))
    cores = near.select(F.col("id").alias("other"), F.col("core").alias("its"))
    return pairs.join(cores, "other").select("scope", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.greatest("far", "core", "its").alias("w")).distinct()


def _grow(n_ids: np.ndarray, part: np.ndarray, reach: tuple[np.ndarray, ...], edges: tuple[np.ndarray, ...], sure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of rows 0 to n - 1 as far as listed edges surely are their least ones, rows to be searched, and each row's component's edge.

    part: the components that are known, as a row of each; reach: a, b, w of the last pair of each row's list, as an edge's, or infinite;
    edges: a, b, w; sure: edges that are known to be of the tree. The rows of all components but the largest are asked whose lists end
    before their component's least listed edge (by number, or len(w)).
    """
    n, (a, b, w) = len(n_ids), edges
    m = len(w)
    order = np.lexsort((np.r_[np.zeros(m, np.int64), np.ones(n, np.int64)], np.r_[b, reach[1]], np.r_[a, reach[0]], np.r_[w, reach[2]]))
    is_edge = order < m
    up_to = np.cumsum(is_edge)
    pos = np.empty(n, np.int64)  # edges that come no later than the end of the row's list
    pos[order[~is_edge] - m] = up_to[~is_edge]
    sorted_ = order[is_edge]
    a, b, number = a[sorted_], b[sorted_], np.arange(m)
    root = roots_of(np.r_[np.arange(n), a[sure[sorted_]]], np.r_[part, b[sure[sorted_]]], n)
    while True:
        p, q = root[a], root[b]
        alive = p != q
        a, b, number, p, q = a[alive], b[alive], number[alive], p[alive], q[alive]
        best, low = np.full(n, m), np.full(n, m + 1)
        back = slice(None, None, -1)
        best[p[back]] = number[back]  # the last one written is the least
        np.minimum.at(best, q, number)
        np.minimum.at(low, root, pos)
        tops = np.unique(root)
        take = tops[(best[tops] < m) & (best[tops] < low[tops])]
        if not len(take):
            break
        at = np.searchsorted(number, np.unique(best[take]))
        root = roots_of(p[at], q[at], n)[root]
    tops, sizes = np.unique(root, return_counts=True)
    asked = (root != tops[np.argmax(sizes)]) & (pos <= best[root])
    return root, asked, np.r_[sorted_, m][best[root]]


def _parts(edges: DataFrame, found: DataFrame, state: DataFrame) -> DataFrame:
    """`state` (scope, id, last, reach, part) with the components after `_grow`, asked, and the component's least listed edge (cap_*)."""
    put = edges.select("scope", "a", "b", "w", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("part"))
    put = put.unionByName(found.select("scope", "a", "b", "w", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("part")))
    put = put.unionByName(state.select("scope", F.col("id").alias("a"), F.col("last").alias("b"), F.col("reach").alias("w"), F.lit(2).alias("kind"), "part"))

    def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b, w, kind = (table.column(c).to_numpy() for c in ("a", "b", "w", "kind"))
        rows = np.flatnonzero(kind == 2)
        rows = rows[np.argsort(a[rows])]
        part = table.column("part").take(pa.array(rows)).to_numpy()
        ids, edge = a[rows], kind < 2
        at = lambda v: np.searchsorted(ids, v)
        ends = at(a[edge]), at(b[edge]), w[edge]
        one, two = at(ids), at(b[rows])
        root, asked, cap = _grow(ids, at(part), (np.minimum(one, two), np.maximum(one, two), w[rows]), ends, kind[edge] == 1)
        none = cap == len(ends[2])
        cap_a, cap_b, cap_w = (pa.array(np.append(v, v.dtype.type(0))[cap], mask=none) for v in (a[edge], b[edge], w[edge]))
        scope = pa.array([key[0].as_py()] * len(ids), pa.string())
        return pa.table({"scope": scope, "id": ids, "last": b[rows], "reach": w[rows], "part": ids[root], "asked": pa.array(asked), "cap_a": cap_a, "cap_b": cap_b, "cap_w": cap_w})

    return put.groupBy("scope").applyInArrow(grow, "scope string, id bigint, last bigint, reach double, part bigint, asked boolean, cap_a bigint, cap_b bigint, cap_w double")


def _search(rows: DataFrame, side: int) -> DataFrame:
    """scope, a, b, w: the least edge of every component with asked rows; rows: scope, id, v, at, blocks, core, part, asked, cap_*."""
    asked = rows.where("asked")
    asked = materialise(lookup(asked, "scope", asked.groupBy("scope").agg(F.ceil(F.count("*") / side).cast("int").alias("ways"))), "asked")
    ways = asked.select("scope", "ways").distinct()
    names = ["scope", "i", "j", "id", "v", "core", "part", "cap_w", "left"]
    left = asked.withColumn("i", F.pmod(F.xxhash64("id"), F.col("ways")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("left", F.lit(True))
    right = lookup(rows, "scope", ways).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).withColumn("j", F.col("at")).withColumn("left", F.lit(False))

    def seek(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v, ids, core, part, is_left = _matrix(table), *(table.column(c).to_numpy() for c in ("id", "core", "part")), table.column("left").to_numpy(zero_copy_only=False)
        cap_w = table.column("cap_w").to_numpy(zero_copy_only=False).astype(float)
        a, b = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        x, y, slack = v[a], v[b], _slack(v[a], v[b])
        parts, of = np.unique(part[a], return_inverse=True)
        more = lambda z: z * (1 + 1e-12) + slack
        cap = np.full(len(parts), np.inf)
        held = np.where(np.isnan(cap_w[a]), np.inf, cap_w[a])
        np.minimum.at(cap, of, more(held**2))
        best = [np.full(len(parts), np.inf), np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), np.iinfo(np.int64).max)]
        for i, j, d in _tiles(x, y):
            own, its = a[i : i + d.shape[0]], b[j : j + d.shape[1]]
            np.maximum(d, core[own, None] ** 2, out=d)
            np.maximum(d, core[None, its] ** 2, out=d)
            d[part[own, None] == part[None, its]] = np.inf
            np.minimum.at(cap, of[i : i + d.shape[0]], more(d.min(axis=1)))
            p, q = np.nonzero(d <= more(cap[of[i : i + d.shape[0]], None]))
            keep = np.isfinite(d[p, q])
            p, q = p[keep], q[keep]
            if not len(p):
                continue
            w = np.maximum(np.maximum(_pairs_far(x, p + i, y, q + j), core[own[p]]), core[its[q]])
            one, two, c = np.minimum(ids[own[p]], ids[its[q]]), np.maximum(ids[own[p]], ids[its[q]]), of[p + i]
            w, one, two, c = (np.concatenate(z) for z in ((w, best[0]), (one, best[1]), (two, best[2]), (c, np.arange(len(parts)))))
            first = np.lexsort((two, one, w, c))
            first = first[np.r_[True, np.diff(c[first]) > 0]]
            best = [w[first], one[first], two[first]]
            np.minimum.at(cap, np.arange(len(parts)), more(best[0] ** 2))
        met = np.isfinite(best[0])
        return pa.table({"scope": pa.array([key[0].as_py()] * int(met.sum()), pa.string()), "part": parts[met], "a": best[1][met], "b": best[2][met], "w": best[0][met]})

    made = left.select(*names).unionByName(right.select(*names)).groupBy("scope", "i", "j").applyInArrow(seek, "scope string, part bigint, a bigint, b bigint, w double")
    known = asked.where("cap_w IS NOT NULL").select("scope", "part", F.col("cap_a").alias("a"), F.col("cap_b").alias("b"), F.col("cap_w").alias("w"))
    return made.unionByName(known).groupBy("scope", "part").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("scope", "e.a", "e.b", "e.w").distinct()


def _forest(x: np.ndarray, core: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning tree by mutual reachability of the pairs within a, or of those between a and b: ends and weights.

    Many pairs are equally far, by the core distance of a row that they share; the smaller ends go first then, so that the
    tree is the same however rows are dealt into cells.
    """
    n = len(x)
    near, source, inside = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    if not len(a) or (b is not None and not len(b)):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    of_a = np.zeros(n, bool)
    of_a[a] = True
    rest = b if b is not None else a
    at = int(a[0])
    live = np.concatenate([a, b]) if b is not None else a
    inside[at] = True
    out_a, out_b, out_w = np.zeros(len(live) - 1, np.int64), np.zeros(len(live) - 1, np.int64), np.zeros(len(live) - 1)
    sides = {True: (rest, x[rest], core[rest]), False: (a, x[a], core[a])}
    for k in range(len(live) - 1):
        others, vectors, cores = sides[bool(of_a[at])]
        now = np.maximum(np.maximum(_far(vectors, x[at]), core[at]), cores)
        low, high = np.minimum(others, at), np.maximum(others, at)
        old = source[others]
        first = (low < np.minimum(others, old)) | ((low == np.minimum(others, old)) & (high < np.maximum(others, old)))
        closer = ~inside[others] & ((now < near[others]) | ((now == near[others]) & first))
        near[others[closer]], source[others[closer]] = now[closer], at
        open_ = live[~inside[live]]
        open_ = open_[near[open_] == near[open_].min()]
        if len(open_) > 1:
            open_ = open_[np.lexsort((np.maximum(open_, source[open_]), np.minimum(open_, source[open_])))]
        at = int(open_[0])
        inside[at] = True
        out_a[k], out_b[k], out_w[k] = source[at], at, near[at]
    return out_a, out_b, out_w


def _kruskal(edges: DataFrame) -> DataFrame:
    """The spanning forest of a bounded number of edges (w, a, b, joining ra and rb), in one task."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        own = pa.Table.from_batches(held)
        a, b, w, ra, rb = (own.column(c).to_numpy() for c in ("a", "b", "w", "ra", "rb"))
        _, at = np.unique(np.concatenate([ra, rb]), return_inverse=True)
        one, two = at[: len(a)].tolist(), at[len(a) :].tolist()
        parent = list(range(int(at.max()) + 1))
        kept = []
        for e in np.lexsort((b, a, w)).tolist():
            p, q = one[e], two[e]
            while parent[p] != p:
                parent[p] = parent[parent[p]]
                p = parent[p]
            while parent[q] != q:
                parent[q] = parent[parent[q]]
                q = parent[q]
            if p != q:
                parent[p] = q
                kept.append(e)
        yield from own.take(pa.array(kept, pa.int64())).to_batches(max_chunksize=100_000)

    return edges.coalesce(1).mapInArrow(solve, edges.schema)


def spanning_forest(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """The edges (a, b, w, any others) of the minimum spanning forest, by Borůvka rounds; ties go to the smaller a, then b.

    Each pair of ends stands once, a before b. finish: edges that one task may hold; 0 leaves none to it.
    """
    names = edges.columns
    now = materialise(edges.withColumns({"ra": F.col("a"), "rb": F.col("b")}), "edges")
    taken = []
    while True:
        left = now.count()
        if left <= finish or left == 0:
            break
        # every component's least edge; the minimum is aggregated before the shuffle, so a large component is no task's burden
        edge = F.struct("w", "a", "b")
        both = now.select(F.col("ra").alias("r"), edge.alias("e"), "ra", "rb").unionByName(now.select(F.col("rb").alias("r"), edge.alias("e"), "ra", "rb"))
        best = both.groupBy("r").agg(F.min(F.struct("e", "ra", "rb")).alias("m")).select("m.*").distinct()
        best = materialise(best.select("e.a", "e.b", "ra", "rb"), "least")
        taken.append(materialise(now.join(best.select("a", "b"), ["a", "b"], "left_semi").select(*names), "taken"))
        roots = components(best.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        up = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_up"))
        half = lookup(materialise(lookup(now, "ra", up("ra"), how="left"), "half"), "rb", up("rb"), how="left")
        moved = half.withColumns({"ra": F.coalesce("ra_up", "ra"), "rb": F.coalesce("rb_up", "rb")})
        now = materialise(moved.where("ra <> rb").select(*names, "ra", "rb"), "edges")
    last = _kruskal(now).select(*edges.columns)
    for t in taken:
        last = last.unionByName(t.select(*edges.columns))
    return last


def tree_clusters(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> np.ndarray:
    """Cluster of each of n rows, -1 for noise, from edges that hold their spanning tree; numbered by their first rows.

    Flat arrays throughout: about a hundred bytes a row.
    """
    if n < least or n < 2:
        return np.full(n, -1, np.int64)
    one, two, size = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64), np.ones(2 * n - 1, np.int64)
    height, parent = np.zeros(2 * n - 1), list(range(n))
    top = list(range(n))  # of a row's set: the node of the tree of merges that holds it
    order = np.lexsort((b, a, w))
    node = n - 1
    for p, q, h in zip(a[order].tolist(), b[order].tolist(), w[order].tolist(), strict=True):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        while parent[q] != q:
            parent[q] = parent[parent[q]]
            q = parent[q]
        if p == q:
            continue
        node += 1
        one[node], two[node], height[node] = top[p], top[q], h
        size[node] = size[top[p]] + size[top[q]]
        if size[top[p]] > size[top[q]]:
            p, q = q, p
        parent[p] = q
        top[q] = node
    # from the root down: a split counts only if both sides are large enough, smaller sides fall out of the cluster
    cluster, fallen = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, bool)
    born, above, stable = [0.0], [-1], [0.0]
    for node in range(2 * n - 2, -1, -1):
        c = int(cluster[node])
        if node < n:
            if not fallen[node]:
                stable[c] += SURE - born[c]
            continue
        sides = (int(one[node]), int(two[node]))
        if fallen[node]:
            for side in sides:
                cluster[side], fallen[side] = c, True
            continue
        dense = min(1 / height[node], SURE) if height[node] > 0 else SURE
        if min(size[s] for s in sides) >= least:
            for side in sides:
                cluster[side] = len(born)
                born.append(dense)
                above.append(c)
                stable.append(0.0)
            stable[c] += (dense - born[c]) * int(size[node])
            continue
        for side in sides:
            cluster[side] = c
            if size[side] < least:
                fallen[side] = True
                stable[c] += (dense - born[c]) * int(size[side])
    below, chosen = [0.0] * len(born), [c > 0 for c in range(len(born))]
    has_kids = [False] * len(born)
    for c in range(len(born) - 1, 0, -1):
        if has_kids[c] and below[c] > stable[c]:
            chosen[c], stable[c] = False, below[c]
        below[above[c]] += stable[c]
        has_kids[above[c]] = True
    final = [-1] * len(born)
    for c in range(1, len(born)):
        final[c] = final[above[c]] if final[above[c]] >= 0 else c if chosen[c] else -1
    out = np.array(final, np.int64)[cluster[:n]]
    seen, first = np.unique(out[out >= 0], return_index=True)
    rank = np.full(len(born) + 1, -1, np.int64)
    rank[seen[np.argsort(first)]] = np.arange(len(seen))
    return np.where(out >= 0, rank[out], -1)


def density_clusters(rows: DataFrame, least: int = LEAST_CLUSTER, cell: int = CELL, finish: int = FINISH) -> DataFrame:
    """scope, skill_id, cluster (-1: none) from scope, skill_id, vec; a scope's clusters are numbered by their least skill_id.

    Within a scope vectors of different lengths are an error, as are null and empty ones. A scope of fewer than `least` skills is
    all noise, as are vectors whose norm is not finite. A skill_id stands once; a null scope is a scope. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    key = F.coalesce(F.concat(F.lit("s"), F.col("scope")), F.lit(""))  # a null scope as a key of its own
    kind = "array<float>" if rows.schema["vec"].dataType.simpleString() == "array<float>" else "array<double>"
    own = materialise(rows.select(key.alias("scope"), F.col("skill_id").alias("id"), F.col("vec").cast(kind).alias("v")), "vectors")
    size = F.coalesce(F.size("v"), F.lit(0))
    sound = F.coalesce(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")) < 1e300, F.lit(False))
    stats = own.groupBy("scope").agg(F.count(F.when(sound, 1)).alias("n"), F.min(F.when(F.col("v").isNull(), 0).otherwise(size)).alias("low"), F.max(size).alias("high"))
    stats = materialise(stats, "scopes")
    if stats.where("low <> high OR low < 1").limit(1).count():
        raise ValueError("a scope has vectors of different lengths, or none")
    wide = F.greatest(F.lit(cell), F.lit(CELL_BYTES) / (8 * F.col("high")))
    blocks = F.least(F.ceil(F.col("n") / cell), F.greatest(F.lit(WAYS), F.ceil(F.col("n") / wide))).cast("int")
    large = stats.where(F.col("n") >= max(least, 2)).select("scope", "n", blocks.alias("blocks"))
    counted = lookup(own.where(sound), "scope", large.select("scope", "blocks")).withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    counted = materialise(counted, "counted")
    lists = large.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    near = materialise(_nearest(counted, least, max(spark.sparkContext.defaultParallelism, lists // MERGED)), "near")
    edges = materialise(spanning_forest(_listed_edges(near), finish), "forest")
    full = F.size("ids") >= least - 1 + MORE  # a shorter list has all rows of the scope
    last = F.when(full, F.element_at("ids", -1)).otherwise(F.col("id"))
    state = near.select("scope", "id", last.alias("last"), F.when(full, F.element_at("far", -1)).otherwise(F.lit(float("inf"))).alias("reach"), F.col("id").alias("part"))
    found = edges.where("false")
    while True:
        state = materialise(_parts(edges, found, state), "parts")
        if not state.where("asked").limit(1).count():
            break
        meeting = materialise(counted.join(near.select("id", "core"), "id").join(state.drop("scope"), "id"), "meeting")
        found = materialise(found.unionByName(_search(meeting, cell)), "found")

    def clusters(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        found = tree_clusters(len(ids), at[: len(a)], at[len(a) :], w, least)
        return pa.table({"id": pa.array(ids), "cluster": pa.array(found)})

    labels = edges.unionByName(found).groupBy("scope").applyInArrow(clusters, "id bigint, cluster bigint")
    named = F.when(F.col("scope") != "", F.substring("scope", 2, 1 << 30)).alias("scope")
    return own.select("scope", "id").join(labels, "id", "left").select(named, F.col("id").alias("skill_id"), F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"))
