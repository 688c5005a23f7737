"""Operator 7, toxicity: distance-weighted votes of the nearest labelled examples by exact TF-IDF cosine.

The classifier is fitted to at most `most_rows` labelled rows, those of the least hashes of their ids; that bound is its
only one. Rows of equal text are one example. Every word of two examples or more is a term. A term weighs by its
frequency in the text, by how rare it is, and by how much it tells about the label: the square root of its chi-square,
plus one, per example. So clean and toxic texts alike have vectors and neighbours, while neighbours agree in what matters.

Examples stand in an order that puts like ones together and are cut into blocks. The inverted index holds, for every
term and block, the greatest weight and the postings, in flat arrays. A query adds up the bounds of each block, visits
blocks from the greatest bound on, and stops when no bound left reaches its nearest examples: the result is exact.
Votes are weighted by cosine, shrunk to the share of positives, and calibrated by a logistic curve that is fitted to
votes of the examples without themselves. The nearest examples' ids and cosines are the evidence.
The index is bounded by its rows, is built by one task and broadcast; every document is scored where it is read, without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrade.llm.common import alnum_words, apart, append_columns, as_bytes, bounded_sample, share, without
from loomgrade.session import table

ROWS = 4_096  # labelled rows that are learnt from, at most
NEAREST = 15
EVIDENCE = 3  # examples that a score names
BLOCK = 64
FIRST = 4  # blocks that a query visits first; then four times as many, and so on
COMMON = 5  # a list of more than one in so many examples is a column
SEEDS = 48  # examples that the others are ordered by
PULL = 10.0  # weight of the identity when the curve is fitted, in rows
PIECE = 4 << 20  # bytes of the index that a row holds on its way to the driver
KEPT = 2_048  # scores of different term vectors that a task keeps for repeated texts


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs start, start + 1, ..., one run after the other."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Index:
    """Terms by number; examples' vectors as flat arrays (rows of `row`, terms `term`, counts `count`), sorted by row and term."""

    terms: dict[bytes, int]
    weight: np.ndarray  # of each term
    row: np.ndarray
    term: np.ndarray
    count: np.ndarray
    positive: np.ndarray  # label of each example
    ids: np.ndarray  # doc_id of each example
    prior: float  # share of positives
    empty: float  # share of positives among examples without terms, shrunk
    slope: float = 1.0
    shift: float = 0.0
    placed: bool = False  # rows are numbered by place already
    blocks: int = field(init=False, default=0)

    def __post_init__(self):
        n = len(self.positive)
        raw = (1 + np.log(np.maximum(self.count, 1))) * self.weight[self.term]
        norm = np.sqrt(np.bincount(self.row, raw * raw, minlength=n))
        value = raw / np.where(norm > 0, norm, 1)[self.row]
        place = np.empty(n, np.int32)
        place[np.arange(n) if self.placed else self._order(value, n)] = np.arange(n)
        row = place[self.row]
        self.positive = self.positive[np.argsort(place)] if n else self.positive
        self.ids = self.ids[np.argsort(place)] if n else self.ids
        order = np.lexsort((row, self.term))
        row, term, count, value = row[order], self.term[order], self.count[order], value[order]
        # lists that hold a fifth of the examples are columns: cheaper to multiply than to walk
        self.column = np.full(len(self.weight), -1)
        common = np.flatnonzero(np.bincount(term, minlength=len(self.weight)) * COMMON > n)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((n, len(common)))
        at = self.column[term]
        self.dense[row[at >= 0], at[at >= 0]] = value[at >= 0]
        every = (row, term, count)
        row, term, value = row[at < 0], term[at < 0], value[at < 0]
        self.posting, self.value = row.astype(np.int32), value
        self.blocks = -(-n // BLOCK)
        # an entry is a term in a block
        block = row // BLOCK
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(row) else np.zeros(0, np.int64)
        self.entry_block = block[first].astype(np.int32)
        self.entry_start, self.entry_size = first.astype(np.int32), np.diff(np.r_[first, len(row)]).astype(np.int32)
        self.entry_most = np.maximum.reduceat(value, first) if len(row) else np.zeros(0)
        self.entry_at = np.searchsorted(term[first], np.arange(len(self.weight) + 1))
        # the examples' own vectors, by place
        row, term, count = every
        order = np.lexsort((term, row))
        self.row, self.term, self.count = row[order], term[order], count[order]
        self.row_at = np.searchsorted(self.row, np.arange(n + 1))

    def __getstate__(self) -> dict:
        """The examples in the narrowest numbers; lists and columns are made again where they are read."""
        narrow = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        plain = ("weight", "ids", "prior", "empty", "slope", "shift")
        state = {k: getattr(self, k) for k in plain} | {k: narrow(getattr(self, k)) for k in ("row", "term", "count")}
        return state | {"positive": self.positive.astype(np.uint8), "names": b"\n".join(self.terms)}

    def __setstate__(self, state: dict) -> None:
        names = state.pop("names")
        self.__dict__.update(state, placed=True)
        self.terms = {w: i for i, w in enumerate(names.split(b"\n"))} if names else {}
        self.positive = self.positive.astype(float)
        self.row, self.term, self.count = (state[k].astype(np.int32) for k in ("row", "term", "count"))
        self.__post_init__()

    def _order(self, value: np.ndarray, n: int) -> np.ndarray:
        """Examples by the most like of a few seeds, so that a block holds like vectors and its bounds are tight."""
        best, near = np.full(n, -1.0), np.zeros(n, np.int64)
        dense = np.zeros(len(self.weight))
        for i, seed in enumerate(np.linspace(0, max(n - 1, 0), min(n, SEEDS)).astype(np.int64)):
            own = slice(*np.searchsorted(self.row, [seed, seed + 1]))
            dense[self.term[own]] = value[own]
            like = np.bincount(self.row, dense[self.term] * value, minlength=n)
            dense[self.term[own]] = 0
            closer = like > best
            best[closer], near[closer] = like[closer], i
        return np.lexsort((-best, near))

    def vector(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Terms (ascending) and counts of a text's words."""
        bag, get = Counter(words), self.terms.get
        terms = np.fromiter((get(w, -1) for w in bag), np.int64, len(bag))
        counts = np.fromiter(bag.values(), np.int64, len(bag))
        order = np.argsort(terms)
        order = order[np.searchsorted(terms[order], 0) :]
        return terms[order], counts[order]

    def example(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.row_at[e], self.row_at[e + 1])
        return self.term[own], self.count[own]

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEAREST, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k examples of greatest cosine (ties: least place), exactly; only examples that share a term."""
        raw = (1 + np.log(counts)) * self.weight[terms]
        norm = math.sqrt(float(raw @ raw))
        if not norm:
            return np.zeros(0, np.int64), np.zeros(0)
        query = raw / norm
        column = self.column[terms]
        whole = np.zeros(self.dense.shape[1])
        whole[column[column >= 0]] = query[column >= 0]
        score = self.dense @ whole  # of the common terms, for every example
        terms, query = terms[column < 0], query[column < 0]
        start, stop = self.entry_at[terms], self.entry_at[terms + 1]
        entries = _runs(start, stop - start)
        weight = np.repeat(query, stop - start)
        block = self.entry_block.take(entries)
        bound = np.bincount(block, weight * self.entry_most.take(entries), minlength=self.blocks)
        bound = bound + np.maximum.reduceat(score, np.arange(0, len(score), BLOCK))
        order = np.argsort(-bound, kind="stable")
        done, step, least = 0, FIRST, 0.0
        seen = np.zeros(self.blocks, bool)
        while done < len(order) and bound[order[done]] > 0 and bound[order[done]] >= least - 1e-9:
            some = order[done : done + step]
            some = some[(bound[some] > 0) & (bound[some] >= least - 1e-9)]
            done, step = done + step, 4 * step
            visited = np.zeros(self.blocks, bool)
            visited[some] = seen[some] = True
            # a block's postings add up term by term, whichever blocks are visited with it
            own = np.flatnonzero(visited.take(block))
            e = entries.take(own)
            start, size = self.entry_start.take(e), self.entry_size.take(e)
            p = _runs(start, size)
            score = score + np.bincount(self.posting.take(p), np.repeat(weight.take(own), size) * self.value.take(p), minlength=len(score))
            known = score[np.repeat(seen, BLOCK)[: len(score)]]
            if len(known) > k + 1:
                least = np.partition(known, -k - 1)[-k - 1]  # one lower, as the example left out may be among them
        score = np.round(score, 9)
        if skip >= 0:
            score[skip] = 0
        places = np.flatnonzero((score >= round(least, 9)) & (score > 0) & np.repeat(seen, BLOCK)[: len(score)])
        places = places[np.lexsort((places, -score[places]))[:k]]
        return places, score[places]

    def vote(self, terms: np.ndarray, counts: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of positives among the nearest, weighted by squared cosine and shrunk to the prior by one row's weight; the nearest."""
        if not len(terms):
            return self.empty, np.zeros(0, np.int64), np.zeros(0)
        places, cosine = self.nearest(terms, counts, skip=skip)
        w = cosine * cosine
        return float((self.prior + (w * self.positive[places]).sum()) / (1 + w.sum())), places, cosine

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float]]]:
        """Calibrated score, and the nearest examples' ids with their cosines."""
        vote, places, cosine = self.vote(terms, counts)
        v = min(max(vote, 1e-6), 1 - 1e-6)
        s = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log(v / (1 - v)) + self.shift))))
        return s, list(zip(self.ids[places[:EVIDENCE]].tolist(), cosine[:EVIDENCE].tolist(), strict=True))

    def calibrate(self) -> None:
        """Fit the logistic curve to votes of examples without themselves; Newton steps with a pull to the identity."""
        votes = np.array([self.vote(*self.example(e), skip=e)[0] for e in range(len(self.positive))])
        if not len(votes):
            return
        v, y = np.clip(votes, 1e-6, 1 - 1e-6), self.positive
        x = np.log(v / (1 - v))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([((p - y) * x).sum() + PULL * (a - 1), (p - y).sum() + PULL * b])
            d = p * (1 - p)
            h = np.array([[(d * x * x).sum() + PULL, (d * x).sum()], [(d * x).sum(), d.sum() + PULL]])
            step = np.clip(np.linalg.solve(h, g), -1, 1)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(min(max(a, 0.1), 10.0)), float(b)


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id, y: labels that may be learnt from; a doc_id of several labels counts as toxic if one of them says so."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0")
    return known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))


def term_weights(d: np.ndarray, p: np.ndarray, n: int, ones: int) -> np.ndarray:
    """Of terms in d of n examples, p of them among `ones` positives: rarity times the root of chi-square (plus one) per example."""
    idf = np.log((n + 1) / (d + 1)) + 1
    zeros = n - ones
    if not ones or not zeros:
        return idf
    chi = n * (p * zeros - (d - p) * ones) ** 2 / (d * (n - d + 0.5) * ones * zeros)
    return idf * np.sqrt((chi + 1) / n)


def build(words: pa.ListArray, counts: pa.ListArray, y: np.ndarray, ids: np.ndarray) -> Index:
    """The index of examples: each one's different words with their counts."""
    n, ones = len(y), int(y.sum())
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    word, count = coded.indices.to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
    d = np.bincount(word, minlength=len(coded.dictionary))
    kept = np.flatnonzero(d >= 2)
    number = np.full(len(d), -1, np.int32)
    number[kept] = np.arange(len(kept))
    names = coded.dictionary.take(pa.array(kept)).to_pylist()
    on = number[word] >= 0 if len(word) else np.zeros(0, bool)
    row, term, count = row[on], number[word[on]], count[on]
    del word, on, coded
    p = np.bincount(term, y[row], minlength=len(kept))
    prior = ones / n if n else 0.0
    bare = np.bincount(row, minlength=n) == 0
    empty = (float(y[bare].sum()) + prior) / (float(bare.sum()) + 1)
    order = np.lexsort((term, row)).astype(np.int32)
    row, term, count = row[order], term[order], count[order]
    index = Index({w: i for i, w in enumerate(names)}, term_weights(d[kept], p, n, ones), row, term, count, y.astype(float), ids, prior, empty)
    index.calibrate()
    return index


@dataclass(frozen=True)
class Model:
    """An index as bytes: the driver only passes it on, and a worker process makes it once."""

    data: bytes
    name: str

    def index(self) -> Index:
        if self.name not in _made:
            _made.clear()
            _made[self.name] = pickle.loads(self.data)
        return _made[self.name]


_made: dict[str, Index] = {}


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = ROWS) -> Model:
    """The index of labelled rows. docs: doc_id, text; labels: doc_id, toxic. Without positive labels every score is 0."""
    known = learnable(labels)
    own = bounded_sample(known, ["doc_id"], most_rows).collect()
    own = docs.sparkSession.createDataFrame(sorted(own)[:most_rows], "doc_id bigint, y int")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")
    # copies of a text would make each of its words look like a sign of its label
    text = F.coalesce("text", F.lit(""))
    rows = rows.groupBy(F.xxhash64(text).alias("h")).agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"), F.max(text).alias("text"))

    def bags():
        def work(batch):
            found = [sorted(Counter(alnum_words(t)).items()) for t in as_bytes(batch.column("text"))]
            return [[[w for w, _ in f] for f in found], [[n for _, n in f] for f in found]]

        return work

    made = append_columns(rows, bags, "words array<binary>, counts array<int>", drop=("text",))

    def index(batches):
        """One task builds the index of at most `most_rows` rows and hands it on in pieces."""
        own = [b for b in batches if b.num_rows]
        data = pickle.dumps(_of_rows(pa.Table.from_batches(own) if own else None), protocol=5)
        for i in range(0, len(data), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([data[i : i + PIECE]], pa.binary())], names=["at", "data"])

    pieces = made.repartition(1).mapInArrow(index, "at bigint, data binary").collect()
    data = b"".join(r.data for r in sorted(pieces, key=lambda r: r.at))
    return Model(data, hashlib.sha256(data).hexdigest())


def _of_rows(made: pa.Table | None) -> Index:
    if made is None:
        return build(pa.array([], pa.list_(pa.binary())), pa.array([], pa.list_(pa.int32())), np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = pc.sort_indices(made.select(["doc_id", "h"]), [("doc_id", "ascending"), ("h", "ascending")])
    words, counts = (_one(made.column(c)).take(order) for c in ("words", "counts"))
    y, ids = (made.column(c).take(order).to_numpy() for c in ("y", "doc_id"))
    return build(words, counts, y.astype(np.int64), ids.astype(np.int64))


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


@apart
def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1), predicted (1 from 0.5 on) and evidence (doc_id and cosine of the nearest examples, nearest first).

    docs: a column text, any others. Null and empty texts, and texts without a term, have the score of such examples and
    no evidence. Ties of cosine (to nine places) go by the examples' fixed order. Repeated rows score alike; an empty
    table gives an empty result.
    """
    shared = share(docs.sparkSession, model)

    def make():
        own, known = shared.value.index(), {}

        def work(batch):
            out, why = [], []
            for text in as_bytes(batch.column("text")):
                terms, counts = own.vector(alnum_words(text))
                key = terms.astype(np.int32).tobytes() + counts.astype(np.int32).tobytes()
                got = known.get(key)
                if got is None:
                    if len(known) >= KEPT:
                        known.clear()
                    got = known[key] = own.score(terms, counts) if own.prior else (0.0, [])
                out.append(got[0])
                why.append([{"doc_id": i, "cosine": c} for i, c in got[1]])
            return [out, [int(s >= 0.5) for s in out], why]

        return work

    return append_columns(without(docs, ["score", "predicted", "evidence"]), make, "score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those predicted toxic."""
    return score(docs, fit(docs, labels)).where("predicted = 0").drop("score", "predicted", "evidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.expr("coalesce(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, false)")
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")
