"""Operator 9, exact top-k search: vectors in buckets of like length, pruned by length or by coordinates, then verified.

Vectors are integers: floor(1024 x) of each component. Candidates stay where they are read. Each batch of them is sorted
by length and cut into buckets; a query's k-th best score so far, over its own length and the bucket's greatest, is the
bucket's local cosine threshold. Above 1 nothing in the bucket can enter. Near 1, few candidates are long enough or
agree with the query in its strongest coordinates, and bounds on those prune before the products are verified. Low
thresholds prune by length alone, where one matrix product is cheaper.
Queries go in blocks of a fixed size. Every task starts from the scores of a bounded sample, true lower bounds, so what
leaves a task is about what can enter the result; a window per query merges the tasks' candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrade.llm.common import bounded_sample
from loomgrade.session import materialise, table

K = 10
BUCKET = 1024
BLOCK = 4096  # queries that are broadcast together
SAMPLE = 20_000  # candidates whose scores give each query's first bound
FOCUS = 8  # strongest coordinates of a query that bound a product
NEAR = 0.6  # local cosine threshold from which coordinates prune
EXACT = 2**53


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array<double> of whole numbers), for vectors without null or non-finite components; empty ones take no part."""
    x = F.col(vec_col)
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(x.isNotNull() & (F.size(x) > 0) & F.col(id_col).isNotNull()).where(good)
    # as a double throughout: a long could not hold what large components give
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), x.cast("array<double>").alias("v"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(-1, d) * 1024.0)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as long where they fit, else as Python's integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a], dtype=object)


class Searcher:
    """The queries of one block, all of one dimension, with their best k so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K, floor: np.ndarray | None = None):
        self.ids, self.v, self.k = ids, vectors, k
        self.length = np.sqrt((vectors * vectors).sum(axis=1))
        self.focus = np.argsort(-np.abs(vectors), axis=1)[:, :FOCUS]
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()  # a score below it cannot enter
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id)
        self.verified = self.pruned = 0

    def feed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        length = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        for a in range(0, len(order), BUCKET):
            own = order[a : a + BUCKET]
            self._bucket(ids[own], vectors[own], length[own])

    def _bucket(self, ids: np.ndarray, vectors: np.ndarray, length: np.ndarray) -> None:
        slack = 1 + 1e-9
        reach = self.length * length[0] * slack
        alive = np.flatnonzero((reach >= self.floor) | np.isneginf(self.floor))
        self.pruned += (len(self.ids) - len(alive)) * len(ids)
        if not len(alive):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach[alive] > 0, self.floor[alive] / reach[alive], -1.0)
        low, high = alive[local < NEAR], alive[local >= NEAR]
        for a in range(0, len(low), 256):  # by length: candidates too short for the least floor of the block fall away together
            q = low[a : a + 256]
            need = self.floor[q].min() / max(self.length[q].max(), 1e-300) / slack
            n = len(ids) if not np.isfinite(need) or need <= 0 else int(np.searchsorted(-length, -need, side="right"))
            if n:
                self._verify(q, _products(self.v[q], vectors[:n]), ids[:n])
        for q in high:  # by coordinates: the strongest exactly, the others by Cauchy and Schwarz
            f = self.focus[q]
            part = vectors[:, f]
            rest_q = max(0.0, self.length[q] ** 2 - (self.v[q, f] ** 2).sum()) ** 0.5
            rest = np.sqrt(np.maximum(0.0, length**2 - (part * part).sum(axis=1)))
            keep = np.flatnonzero((part @ self.v[q, f] + rest_q * rest) * slack + 1e-6 >= self.floor[q])
            self.pruned += len(ids) - len(keep)
            if len(keep):
                self._verify(np.array([q]), _products(self.v[q : q + 1], vectors[keep]), ids[keep])

    def _verify(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.verified += scores.size
        for row, q in zip(scores, queries.tolist(), strict=True):
            at = np.flatnonzero((row >= self.floor[q]) & (ids != self.ids[q]))
            if not len(at):
                continue
            if len(at) > 4 * self.k and row.dtype != object:  # ties at the edge stay in, for their ids to decide
                edge = np.partition(row[at], len(at) - self.k)[len(at) - self.k]
                at = at[row[at] >= edge]
            best = sorted(self.found[q] + [(-int(s), int(i)) for s, i in zip(row[at], ids[at], strict=True)])[: self.k]
            self.found[q] = best
            if len(best) == self.k:
                self.floor[q] = max(self.floor[q], -best[-1][0])


def search(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    Both sides: vec_id, v, as `quantised` gives them. A candidate of the query's own vec_id takes no part, nor does one of
    another dimension. A query_id of several rows counts with its least vector. Candidates of equal vec_id are different
    candidates. Fewer candidates give fewer rows; empty tables give none.
    """
    spark = candidates.sparkSession
    queries = materialise(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-queries.count() // block))
    seeds = bounded_sample(candidates, ["vec_id", "v"], sample).collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r.v) for r in seeds}:
        own = [r for r in seeds if len(r.v) == d]
        by_dim[d] = np.array([r.vec_id for r in own], np.int64), np.floor(np.array([r.v for r in own]) * 1024.0)
    out = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = own.collect()
        searchers = {}
        for d in {len(r.v) for r in rows}:
            mine = sorted((r for r in rows if len(r.v) == d), key=lambda r: r.vec_id)
            s = Searcher(np.array([r.vec_id for r in mine], np.int64), np.floor(np.array([r.v for r in mine]) * 1024.0), k)
            if d in by_dim:
                s.feed(*by_dim[d])
            searchers[d] = (s.ids, s.v, s.floor)
        shared = spark.sparkContext.broadcast(searchers)

        def run(batches, shared=shared):
            own = {d: Searcher(i, v, k, f) for d, (i, v, f) in shared.value.items()}
            for batch in batches:
                v = batch.column("v")
                sizes = np.diff(v.offsets.to_numpy())
                ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                for d in np.unique(sizes).tolist():
                    if d in own:
                        at = np.flatnonzero(sizes == d)
                        own[d].feed(ids[at], _matrix(v.take(pa.array(at)), d))
            for s in own.values():
                hits = [(int(q), i, -neg) for q, best in zip(s.ids, s.found, strict=True) for neg, i in best]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([min(max(h[2], -(2**63)), 2**63 - 1) for h in hits], pa.int64())], names=["query_id", "vec_id", "score"])

        found = candidates.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        if blocks > 1:  # one block's queries at a time are held
            found = materialise(found, "found")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows.where("vec_id % 100 = 0"), rows)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
