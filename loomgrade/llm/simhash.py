"""Operator 4, SimHash near-dedup: vantage-point trees over 64-bit fingerprints, exact pairs, one component id a document.

Equal fingerprints are one point. A vantage-point tree, fitted to a bounded sample of points, parts the points by
Hamming distance from its vantage points. A point lives in one shard; by the triangle bound its ball of the link
distance can only reach into the other side of a vantage point if its distance lies within that reach of the radius,
and only then is it copied there to query. Of two points on different sides, only the outer one is copied. So every pair
within the distance meets in a shard. A shard links its points to a representative each, never all pairs, and components
over those links give the ids. A shard that has outgrown its size is dealt into blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrade.llm.common import apart, append_columns, as_bytes, bounded_sample, share, space_words, without
from loomgrade.operators.components import components
from loomgrade.operators.skew import lookup
from loomgrade.session import materialise, table

SHINGLE = 3
DISTANCE = 3
SHARD = 1024  # points that live in a shard, about
SAMPLE = 65_536  # points that the tree is fitted to, at most


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash over the shingles of words; zero without words."""
    words = space_words(text)
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    n = len(words) - width + 1
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        h = np.fromiter((digest(line[i:j], 42) for i, j in zip(begin[a:b].tolist(), end[a + width - 1 : b + width - 1].tolist(), strict=True)), np.uint64, b - a)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """Add fp: the fingerprint's 64 bits as a signed long."""

    def make():
        def work(batch):
            return [pa.array(np.array([fingerprint(t, width) for t in as_bytes(batch.column("text"))], np.uint64).view(np.int64), pa.int64())]

        return work

    return append_columns(without(docs, ["fp"]), make, "fp bigint", drop=() if keep_text else ("text",))


class Tree:
    """A vantage-point tree: node i has a vantage point and a radius; inner points go to child 2i+1, outer ones to 2i+2.

    A vantage point may look at some of the bits only: such a distance, too, changes by no more than the Hamming
    distance does, so the triangle bound holds.
    """

    def __init__(self, sample: np.ndarray, depth: int, reach: int = DISTANCE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.reach = depth, reach
        nodes = (1 << depth) - 1
        self.point, self.mask, self.radius = np.zeros(nodes, np.uint64), np.full(nodes, ~np.uint64(0)), np.full(nodes, 64, np.int64)
        groups = {0: sample}
        for i in range(nodes):
            own = groups.pop(i, sample[:0])
            if len(own):
                self.point[i], self.mask[i], self.radius[i], d = self._choose(own, rng)
                groups[2 * i + 1], groups[2 * i + 2] = own[d <= self.radius[i]], own[d > self.radius[i]]

    def _choose(self, own: np.ndarray, rng) -> tuple:
        """Of points of the sample, and of the directions in which its bits vary most, what parts it fairly with the fewest copies."""
        everything = ~np.uint64(0)
        options = [(p, everything) for p in own[rng.integers(0, len(own), 8)]]
        some = own[:4000]
        bits = 2.0 * np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") - 1
        if len(some) > 8:
            _, axes = np.linalg.eigh(np.cov(bits.T))
            for axis in axes.T[:-5:-1]:
                point = np.packbits(axis > 0, bitorder="little").view("<u8")[0]
                for n in (8, 16, 24, 32, 48, 64):
                    chosen = np.zeros(64, bool)
                    chosen[np.argsort(-np.abs(axis))[:n]] = True
                    options.append((point, np.packbits(chosen, bitorder="little").view("<u8")[0]))
        best = None
        for p, m in options:
            d = np.bitwise_count((own ^ p) & m).astype(np.int64)
            below = np.cumsum(np.bincount(d, minlength=72))
            for r in np.flatnonzero((below[:64] >= 0.25 * len(own)) & (below[:64] <= 0.75 * len(own))):
                copied = below[min(71, r + self.reach)] - below[r]
                cost = copied + abs(2 * below[r] - len(own)) / 4
                if best is None or cost < best[0]:
                    best = (cost, p, m, int(r), d)
        if best is None:  # no radius parts them fairly
            d = np.bitwise_count(own ^ own[0]).astype(np.int64)
            best = (0, own[0], everything, int(np.median(d)), d)
        return best[1:]

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of a point, shard, and whether it lives there; else it is a copy that queries there."""
        index = np.arange(len(points))
        node = np.zeros(len(points), np.int64)
        home = np.ones(len(points), bool)
        for _ in range(self.depth):
            d = np.bitwise_count((points[index] ^ self.point[node]) & self.mask[node]).astype(np.int64)
            r = self.radius[node]
            inner = d <= r + self.reach  # an outer point goes inwards too, as a copy, if its ball reaches in
            outer = np.where(home, d > r, d + self.reach > r)  # of two points on different sides, only the outer one is copied
            lives = home & (d <= r)
            index, node, home = np.concatenate((index[inner], index[outer])), np.concatenate((2 * node[inner] + 1, 2 * node[outer] + 2)), np.concatenate((lives[inner], home[outer]))
        return index, node - ((1 << self.depth) - 1), home


def _links(left: np.ndarray, right: np.ndarray, reach: int, cells: int = 1 << 20):
    """Index pairs of points within the distance, a million comparisons at a time; one set against itself gives each pair once."""
    same = left is right
    block = max(1, cells // max(1, len(right)))
    for a in range(0, len(left), block):
        base = a if same else 0
        i, j = np.nonzero(np.bitwise_count(left[a : a + block, None] ^ right[None, base:]) <= reach)
        i, j = i + a, j + base
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def star_links(home: np.ndarray, copies: np.ndarray, reach: int, inside: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links of points to the least point of their component here: at most one a point.

    Points that live here are compared with each other, if `inside`, and with the copies; copies meet elsewhere.
    """
    points = np.concatenate((home, copies))
    root = np.arange(len(points))
    found = [(i, j) for i, j in _links(home, home, reach)] if inside else []
    found += [(i, j + len(home)) for i, j in _links(home, copies, reach)]
    for a, b in found:
        while True:  # hook the larger root onto the smaller and shorten, until the block's links join equals
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    signed = points.view(np.int64)
    least = np.full(len(points), np.iinfo(np.int64).max)
    np.minimum.at(least, root, signed)
    mine = least[root]
    other = mine != signed
    return signed[other], mine[other]


def near_links(points: DataFrame, reach: int = DISTANCE, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """a, b: links between different fingerprints (column fp, distinct) whose components are those of all pairs within reach."""
    spark = points.sparkSession
    n = points.count()
    # 262,144 shards at most: the tree is broadcast and stays below 8 MB; larger shards go by blocks
    depth = min(18, max(0, int(np.ceil(np.log2(max(1, n) / shard)))))
    picked = [r.fp for r in bounded_sample(points.select("fp"), ["fp"], sample).collect()] if depth else []
    tree = share(spark, Tree(np.array(sorted(picked), np.int64).view(np.uint64), depth, reach))

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for a in range(0, len(fp), 2000):
                own = fp[a : a + 2000]
                index, node, home = tree.value.shards(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(own[index]), pa.array(node), pa.array(home)], names=["fp", "shard", "home"])

    dealt = materialise(points.select("fp").mapInArrow(deal, "fp bigint, shard bigint, home boolean"), "shards")
    # a shard of too many points goes by blocks of those that live there and chunks of copies; each pair of them is a group
    most = 8 * shard
    sizes = dealt.groupBy("shard").agg(F.count_if("home").alias("h"), F.count("*").alias("c"))
    large = sizes.where((F.col("h") > most) | (F.col("c") > 32 * most)).select("shard", F.ceil(F.greatest(F.col("h"), F.lit(1)) / most).cast("int").alias("blocks"), F.ceil(F.col("c") / (32 * most)).cast("int").alias("chunks"))
    large = materialise(large, "large")
    plain = dealt.withColumns({"block": F.lit(0), "chunk": F.lit(0), "own": F.col("home")})
    if large.limit(1).count():
        large = F.broadcast(large) if _small(large) else large
        plain = plain.join(large.select("shard"), "shard", "left_anti")
        own, part = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
        blocks, chunks = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("chunks") - 1)
        # whoever lives in a block is needed with every chunk; others query the blocks after their own, in one chunk of each
        cell = lambda b, c: F.struct(b.alias("block"), c.alias("chunk"), (F.col("home") & (b == own)).alias("own"))
        lives = F.transform(chunks, lambda c: cell(own, c))
        queries = F.transform(F.when(F.col("home"), F.filter(blocks, lambda b: b > own)).otherwise(blocks), lambda b: cell(b, part))
        cells = F.when(F.col("home"), F.concat(lives, queries)).otherwise(queries)
        plain = plain.unionByName(dealt.join(large, "shard").withColumn("cell", F.explode(cells)).select("fp", "shard", "home", "cell.block", "cell.chunk", "cell.own"))

    def link(key, cell):
        fp = cell.column("fp").to_numpy().view(np.uint64)
        own = cell.column("own").to_numpy(zero_copy_only=False)
        a, b = star_links(fp[own], fp[~own], reach, inside=key[2].as_py() == 0)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return plain.groupBy("shard", "block", "chunk").applyInArrow(link, "a bigint, b bigint")


def _small(df: DataFrame, most: int = 50_000) -> bool:
    return df.limit(most + 1).count() <= most


def assign(prints: DataFrame, reach: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """Fingerprint to component: fp, root (least fingerprint of the component), component_id (its least doc_id).

    prints: doc_id, fp, written once.
    """
    points = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    roots = components(near_links(points, reach, shard))
    labelled = materialise(points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "roots")
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    # a root may have a third of the fingerprints, and a fingerprint, as that of empty texts, a third of the documents
    return lookup(labelled, "root", least).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, reach: int = DISTANCE, width: int = SHINGLE, shard: int = SHARD) -> DataFrame:
    """One row for each document: doc_id, fp, root, component_id.

    docs: doc_id, text. Documents link if their fingerprints differ in at most `reach` bits; component_id is the least
    doc_id of the linked documents, itself included, over any number of links. Null, empty and blank texts have the
    fingerprint zero and link like others. Null doc_ids never name a component unless all its documents have none.
    Repeated rows stay rows. An empty table gives an empty result.
    """
    prints = materialise(with_fingerprints(docs.select("doc_id", "text"), width, keep_text=False), "prints")
    return lookup(prints, "fp", assign(prints, reach, shard)).select("doc_id", "fp", "root", "component_id")


@apart
def deduplicate(docs: DataFrame, reach: int = DISTANCE, width: int = SHINGLE, shard: int = SHARD) -> DataFrame:
    """`docs` with one document of each group of linked ones: that of the least doc_id (null last), ties by the text's hash.

    All columns pass through. Rows that repeat a kept document in doc_id and text are left out too; of those, which
    row's other columns stay is not defined.
    """
    doc = without(docs, [])
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    prints = materialise(with_fingerprints(doc.select("doc_id", F.col("text"), h.alias("__h")), width, keep_text=False), "prints")
    roots = assign(prints, reach, shard).select("fp", "root")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__h").alias("h"))
    own = prints.groupBy("fp").agg(F.min(rank).alias("k")).join(roots, "fp")
    kept = own.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.id").alias("__lg_id"), F.col("k.h").alias("__lg_h"))
    many = prints.groupBy("doc_id", "__h").count().where("count > 1").select(F.col("doc_id").alias("__lg_id"), F.col("__h").alias("__lg_h"), F.lit(True).alias("__lg_many"))
    kept = kept.alias("k").join(many.alias("m"), F.expr("k.__lg_id <=> m.__lg_id AND k.__lg_h = m.__lg_h"), "left").select("k.__lg_id", "k.__lg_h", "m.__lg_many")
    out = doc.withColumn("__lg_t", h).join(kept, F.expr("doc_id <=> __lg_id AND __lg_t = __lg_h"))
    once = out.where("__lg_many IS NULL").select(*doc.columns)
    return once.unionByName(out.where("__lg_many").dropDuplicates(["__lg_id", "__lg_h"]).select(*doc.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
