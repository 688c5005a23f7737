"""Connected components of links between rows: roots are hooked onto smaller ones and links are contracted to roots.

A round hooks every root onto the least root within two links, shortens the chains that this makes by pointer jumping,
and replaces the ends of all links by their roots. Links within a component vanish, equal ones become one. A root that
stays is the least within two links, so each of its neighbours has it, and no other one that stays, for its least neighbour:
a round leaves half of the roots at most. Rounds grow with the logarithm of the number of nodes, whatever the
links' shape, and there is no limit to them.
Once so few links are left that one task can surely hold them, a task ends the work. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrade.operators.skew import HOT, lookup
from loomgrade.session import materialise, ship

FINISH = 1_000_000  # links that one task may hold


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, of nodes 0 to n - 1 and links a, b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _finish(links: DataFrame) -> DataFrame:
    """node, root of a bounded number of links, in one task."""
    kind = links.schema["a"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        own = pa.Table.from_batches(held)
        ends = pa.concat_arrays(own.column("a").chunks + own.column("b").chunks)
        names = pc.unique(ends)
        names = names.take(pc.sort_indices(names))
        at = pc.index_in(ends, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        root = roots_of(at[: own.num_rows], at[own.num_rows :], len(names))
        made = pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], names=["node", "root"])
        for start in range(0, made.num_rows, 100_000):
            yield made.slice(start, 100_000)

    ship(links.sparkSession)
    return links.coalesce(1).mapInArrow(solve, f"node {kind}, root {kind}")


def _hook(links: DataFrame, hot: int) -> DataFrame:
    """node, root for the ends of the links: each node's end of the chain of least nodes within two links."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # least neighbours are aggregated before they shuffle, so a node of very many links is no task's burden
    near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    near = materialise(near.select(F.col("node").alias("b"), F.least("node", "m").alias("m")), "near")
    up = lookup(both, "b", near, hot).groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m"))
    up = materialise(up.select("node", F.least("node", "m").alias("root")), "hooks")
    while True:
        next_ = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
        jumped = lookup(up, "root", next_, hot).select("node", F.col("over").alias("root"), (F.col("over") != F.col("root")).alias("moved"))
        jumped = materialise(jumped, "jumps")
        up = jumped.select("node", "root")
        if jumped.where("moved").limit(1).count() == 0:
            return up


def components(links: DataFrame, finish: int = FINISH, hot: int = HOT) -> DataFrame:
    """node, root: the least node that can be reached, for every node of a link to another node.

    links: a, b of one sortable type, in any order, repeats included; links with a null end or of a node to itself say
    nothing. finish: links that one task may hold; 0 leaves none to it. hot: rows of one key that are not shuffled.
    An empty table gives an empty result.
    """
    tidy = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = materialise(tidy.distinct(), "links")
    levels = []
    while True:
        left = now.count()
        if left == 0 or left <= finish:
            break
        roots = _hook(now, hot)
        levels.append(roots)
        ends = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        first = lookup(now, "a", ends, hot).select("b", F.col("ra").alias("a"))
        ends = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        second = lookup(materialise(first, "half"), "b", ends, hot).select("a", F.col("rb").alias("b"))
        second = second.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        now = materialise(second.distinct(), "links")
    found = materialise(_finish(now), "labels")
    for roots in reversed(levels):
        # a root of this round may have moved on in a later one
        over = found.select(F.col("node").alias("root"), F.col("root").alias("over"))
        moved = lookup(roots, "root", over, hot, "left").select("node", F.coalesce("over", "root").alias("root"))
        found = materialise(moved, "labels")
    return found
