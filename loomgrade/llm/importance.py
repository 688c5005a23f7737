"""Operator 11, target-distribution importance resampling over hashed word n-grams, by the algebra of CRC combination.

A CRC is linear over GF(2): crc(A + B) is crc(A) shifted by the length of B, xor crc(B), and a shift by n bytes is the
n-th power of one 32 x 32 bit matrix. So each word's CRC is computed once, and the CRC of "a b c" follows from those of
its words by two shifts; no n-gram is ever built as a string. Matrices are kept as tables by byte: a shift is four
look-ups. Features fall into buckets by their CRC; counts of a bucket in the corpus and in the target give its gain, and
a text's weight is the sum of its features' gains. Gumbel noise of each row's own turns the highest scores into a draw
without replacement.

Nothing of the corpus but `buckets` counts a task shuffles; texts are read twice, and never kept.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrade.llm.common import LOWER, PART_BYTES, apart, append_columns, byte_sizes, row_parts, without
from loomgrade.session import materialise, ship, table

BUCKETS = 10_000
ORDER = 3  # words in the longest feature
TABLED = 64  # lengths below this have a table of their own, longer shifts are made of powers of two
SLICE = 4 << 20  # bytes of a text that are split into words at once
_POLY = 0xEDB88320

_LOWER = np.frombuffer(LOWER, np.uint8)
_IN_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _byte_steps() -> np.ndarray:
    """What a CRC's register becomes by one byte, for each value of its low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLY), c >> 1).astype(np.uint32)
    return c


_STEP = _byte_steps()


def _apply(matrix: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A matrix, as four tables by byte, times each of the vectors c."""
    return matrix[0][c & 255] ^ matrix[1][(c >> 8) & 255] ^ matrix[2][(c >> 16) & 255] ^ matrix[3][c >> 24]


def _identity() -> np.ndarray:
    return np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])


class Shifts:
    """Powers of the matrix that shifts a CRC by one byte."""

    def __init__(self):
        self.short = [_identity()]
        for _ in range(TABLED - 1):
            m = self.short[-1]
            self.short.append(_STEP[m & 255] ^ (m >> 8))
        self.flat = np.stack(self.short)  # length, byte's place, byte
        self.doubled = [self.short[1]]  # by 1, 2, 4, 8 ... bytes

    def power(self, k: int) -> np.ndarray:
        while len(self.doubled) <= k:
            m = self.doubled[-1]
            self.doubled.append(_apply(m, m))
        return self.doubled[k]

    def by(self, c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each CRC shifted by its own length."""
        n = np.minimum(lengths, TABLED - 1)
        out = self.flat[n, 0, c & 255] ^ self.flat[n, 1, (c >> 8) & 255] ^ self.flat[n, 2, (c >> 16) & 255] ^ self.flat[n, 3, c >> 24]
        for i in np.flatnonzero(lengths >= TABLED):
            x, left, k = c[i : i + 1], int(lengths[i]), 0
            while left:
                if left & 1:
                    x = _apply(self.power(k), x)
                left, k = left >> 1, k + 1
            out[i] = x[0]
        return out


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC of each word of lower-cased bytes: all words' first bytes, then all second ones, and so on."""
    c = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(lengths < TABLED)
    for j in range(TABLED):
        live = live[lengths[live] > j]
        if not len(live):
            break
        own = c[live]
        c[live] = _STEP[(own ^ data[starts[live] + j]) & 255] ^ (own >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths >= TABLED):
        c[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    return c


def split(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' CRCs and lengths in concatenated texts that begin at `firsts`, and the index of each text's first word."""
    inside = _IN_WORD[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    at = firsts[firsts < len(data)]
    edge[at] = inside[at]
    starts = np.flatnonzero(edge)
    stop = ~inside
    stop[at] = True
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, side="right")]
    lengths = ends - starts
    return word_crcs(_LOWER[data], starts, lengths), lengths, np.searchsorted(starts, firsts)


def gram_crcs(crcs: np.ndarray, lengths: np.ndarray, order: int, shifts: Shifts) -> list[np.ndarray]:
    """CRCs of the runs of 1, 2, ... `order` words, spaces between them, that end at each word; too early ends are garbage."""
    out, space = [crcs], np.uint32(zlib.crc32(b" "))
    for _ in range(order - 1):
        before = np.zeros_like(crcs)
        before[1:] = _apply(shifts.short[1], out[-1][:-1]) ^ space
        out.append(shifts.by(before, lengths) ^ crcs)
    return out


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in runs of about SLICE bytes that end where no word does."""
    a = 0
    while a < len(data):
        b = min(len(data), a + SLICE)
        while b < len(data):
            gap = np.flatnonzero(~_IN_WORD[data[b : b + 65_536]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(len(data), b + 65_536)
        yield data[a:b]
        a = b


class Featurizer:
    """Buckets of the features of texts, part by part; one a task."""

    def __init__(self, buckets: int, order: int):
        self.buckets, self.order, self.shifts = buckets, order, Shifts()

    def runs(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """For texts of a column: the first text's index, texts' first words, words, and for each order (words' places, buckets).

        A long text comes as several runs with the same index; their features are whole, as the last words are carried.
        """
        kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
        plain = column.cast(kind).fill_null(b"")
        wide = np.int64 if pa.types.is_large_binary(plain.type) else np.int32
        if not len(plain):
            return
        offsets = np.frombuffer(plain.buffers()[1], wide)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64)
        held = plain.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        for a, b in row_parts(len(plain), np.diff(offsets).tolist(), SLICE):
            own = data[offsets[a] : offsets[b]]
            if b - a > 1 or len(own) <= SLICE:
                crcs, lengths, firsts = split(own, offsets[a:b] - offsets[a])
                yield a, firsts, len(crcs), self._features(crcs, lengths, firsts, 0)
                continue
            kept = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            for piece in _slices(own):
                crcs, lengths, _ = split(piece, np.zeros(1, np.int64))
                old = len(kept[0])
                crcs, lengths = np.concatenate([kept[0], crcs]), np.concatenate([kept[1], lengths])
                yield a, np.zeros(1, np.int64), len(crcs) - old, self._features(crcs, lengths, np.zeros(1, np.int64), old)
                kept = crcs[len(crcs) - min(len(crcs), self.order - 1) :], lengths[len(lengths) - min(len(lengths), self.order - 1) :]

    def _features(self, crcs, lengths, firsts, old):
        """Places (of words after the first `old`) and buckets, an order each. A run must not begin before its text."""
        n = len(crcs)
        begins = np.zeros(n + 1, np.int64)
        np.maximum.at(begins, firsts, firsts)
        begins = np.maximum.accumulate(begins[:n])
        out = []
        for k, c in enumerate(gram_crcs(crcs, lengths, self.order, self.shifts)):
            at = np.arange(max(old, k), n)
            at = at[at - k >= begins[at]]
            out.append((at - old, (c[at] % np.uint32(self.buckets)).astype(np.int64)))
        return out


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """bucket, n: how many features of all texts fall into it. A task adds up its own before anything is shuffled."""
    ship(docs.sparkSession)

    def run(batches):
        work, total = Featurizer(buckets, order), np.zeros(buckets, np.int64)
        for batch in batches:
            column = batch.column(0)
            for a, b in row_parts(batch.num_rows, byte_sizes(column), PART_BYTES):
                for *_, features in work.runs(column.slice(a, b - a)):
                    for _, found in features:
                        total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Each bucket's gain, floor(1000 ln(share in the target / share in docs)), each bucket counted once more than it is.

    Both tables need a column text. `buckets` numbers a table come to the driver, whatever the tables' sizes.
    """
    known = []
    for df in (docs, target):
        own = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, buckets, order).collect():
            own[r.bucket] = r.n
        known.append(own)
    s, t = known
    ss, tt = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * ss / ((float(x) + 1) * tt))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


@apart
def score(docs: DataFrame, gain: np.ndarray, order: int = ORDER, seed: int = 42) -> DataFrame:
    """docs (doc_id, text, any others) with n_words, n_features, weight and score.

    weight: sum of the gains of all runs of 1 to `order` words, repeats counted. score: weight plus
    floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the hash of `seed` and doc_id. Null and empty texts have no features
    and weight 0; a null doc_id counts as an empty one. Repeated rows get equal results. Very long texts are read in
    slices. No shuffle.
    """

    def make():
        work = Featurizer(len(gain), order)

        def rows(batch):
            n = batch.num_rows
            words, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for a, firsts, n_words, features in work.runs(batch.column("text")):
                ends = np.append(firsts[1:], n_words)
                words[a : a + len(firsts)] += ends - firsts
                for at, found in features:
                    sums = np.zeros(n_words + 1, np.int64)
                    sums[at + 1] = gain[found]
                    sums = np.cumsum(sums)
                    weight[a : a + len(firsts)] += sums[ends] - sums[firsts]
            features = sum(np.maximum(words - k, 0) for k in range(order))
            noise = np.array([_noise(seed, d) for d in batch.column("doc_id").to_pylist()], np.int64)
            return [pa.array(x) for x in (words, features, weight, weight + noise)]

        return rows

    names = ["n_words", "n_features", "weight", "score"]
    return append_columns(without(docs, names), make, ", ".join(f"{c} bigint" for c in names))


def _noise(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


@apart
def draw(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """scored (doc_id, n_words, score, any others) with rank: 1, 2, 3 ... for the highest scores, null for rows not drawn.

    Of the rows with at least `least_words` words, floor(percent * rows / 100) are drawn; ties go to the smaller doc_id
    (null last), then to fewer words, then to either. A repeated row is a row of its own. Rows that can't be drawn, by an approximate quantile
    that errs on the safe side, take no part in the sort; the others are sorted over all tasks and numbered by prefix
    sums of the tasks' counts. Pass only the columns that are needed: rows are written once.
    """
    rows = materialise(without(scored, ["rank"]), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    n = able.count()
    k = percent * n // 100
    none = F.lit(None).cast("bigint").alias("rank")
    if k <= 0:
        return rows.select("*", none)
    bar = able.agg(F.percentile_approx("score", max(0.0, 1 - k / n - 3e-4), 10_000)).first()[0]
    if able.where(F.col("score") >= bar).count() < k:  # never by the quantile's bound, but right if it were
        bar = -(1 << 63)
    high = (F.col("n_words") >= least_words) & (F.col("score") >= bar)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_words"), F.asc("__lg_salt")]
    ranged = rows.where(high).withColumn("__lg_salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    at = materialise(ranged.withColumn("__lg_at", F.monotonically_increasing_id()), "ranged")
    part, place = F.shiftright("__lg_at", 33), F.col("__lg_at").bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for p, m in sorted((r.p, r.m) for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("m")).collect()):  # a number a task
        before[p], total = total, total + m
    offsets = scored.sparkSession.createDataFrame([(p, b) for p, b in before.items()], "__lg_part bigint, __lg_before bigint")
    ranked = at.withColumn("__lg_part", part).join(F.broadcast(offsets), "__lg_part")
    rank = F.col("__lg_before") + place + 1
    top = ranked.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(rank <= k, rank).alias("rank"))
    return top.unionByName(rows.where(~F.coalesce(high, F.lit(False))).select("*", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, order: int = ORDER, seed: int = 42) -> DataFrame:
    """docs with n_words, n_features, weight, score and rank; `rank IS NOT NULL` is the sample that resembles the target.

    Empty tables: without docs no rows, without target texts every document is weighed by its rarity alone.
    """
    return draw(score(docs, gains(docs, target, buckets, order), order, seed), percent, least_words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gain = gains(docs, table(spark, sf_dir, "benchmark"))
    return draw(score(docs, gain).drop("text")).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE step(b, c, k) AS (SELECT b, b, 0 FROM (SELECT unnest(range(256)) AS b) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
steps AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
orders AS (SELECT unnest([1, 2, 3]) AS n),
dg AS (SELECT r, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, orders WHERE len(w) >= n)),
bg AS (SELECT array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS p FROM b, orders WHERE len(w) >= n)),
dc AS (SELECT r, g, count(*) AS m FROM dg GROUP BY ALL),
grams AS (SELECT DISTINCT g FROM (SELECT g FROM dc UNION ALL SELECT g FROM bg)),
codes AS (SELECT g, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen(g) + 1), lambda i: ('0x' || substr(hex(encode(g)), 2 * i - 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket FROM grams, steps),
s AS (SELECT bucket, sum(m)::DOUBLE AS s FROM dc JOIN codes USING (g) GROUP BY ALL),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM bg JOIN codes USING (g) GROUP BY ALL),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT r, sum(m * gain)::BIGINT AS weight FROM dc JOIN codes USING (g) JOIN gain USING (bucket) GROUP BY ALL),
scored AS (SELECT doc_id, len(w)::BIGINT AS n, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256(concat('42:', doc_id)), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT doc_id, n, score, n_features, weight, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n) AS rank, count(*) OVER () AS total FROM scored WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * total // 100 THEN rank END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n < 20
"""
