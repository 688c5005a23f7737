"""Operator 5, LM scoring: a gated recurrent network over a class-factored vocabulary, trained by truncated backpropagation.

All of the training documents' words are counted on the executors. The most frequent `known_words` words and their
counts are broadcast, a bounded table; counts of all other words stay distributed and are joined to the words that
documents hold beside those.

The network reads classes: each of the `head` most frequent words is a class of its own, other known words go into
classes by frequency, the rest is one class. P(word | history) = softmax over groups of classes, times softmax over the
classes of the group, times the word's add-one share of its class, so the factors sum to one over the vocabulary with
one unseen word. Training starts from the counts' own class shares and runs in parallel, one network a task of the
scan, whose weights are averaged by their tokens after each round; every training document takes part. Scoring carries
the state across windows, so a document's log-likelihood is that of its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrade.llm.common import all_space_words, apart, byte_sizes, row_parts, share, without
from loomgrade.session import materialise, ship, table

KNOWN_WORDS = 131_072  # words whose counts are broadcast, at most
HEAD = 192  # of those, words that are classes of their own
TAILS = 31  # classes of the other known words
GROUP = 16  # classes in a group of the factored softmax
HIDDEN = 16
WINDOW = 24  # steps of truncated backpropagation
ROWS = 64  # texts that are read side by side in training
SCORE_ROWS = 128  # and in scoring, where it changes no result
SHARD_TOKENS = 2_000_000  # tokens that one of the networks trained side by side sees at least, about
TRAIN_TOKENS = 1_000_000  # tokens that a task holds at once
ROUNDS = 1
RATE = 0.04
BATCH_BYTES = 8 << 20
END = b""  # the end of a text; no word is empty


@dataclass
class Vocabulary:
    """Known words with their class and their log10 share of it; class `rest` is everything else, -1 no input yet."""

    number: dict[bytes, int]
    classes: np.ndarray  # of each word by number, then that of all others
    log_count: np.ndarray  # log10 of (c + 1) of each word by number, then 0
    log_mass: np.ndarray  # log10 of each class's share
    start: np.ndarray  # natural log of the classes' shares of all words
    n: int
    v: int

    @property
    def size(self) -> int:
        return len(self.log_mass)


def vocabulary(counts: list[tuple[bytes, int]], n: int, v: int, head: int = HEAD, tails: int = TAILS) -> Vocabulary:
    """counts: the most frequent words with their counts, the end of a text among them if there is one; n, v: all tokens, all different."""
    counts = sorted(counts, key=lambda x: (-x[1], x[0]))
    more = np.array([c + 1.0 for _, c in counts])
    own = np.arange(len(counts))
    if len(counts) > head:  # classes of about equal mass
        rest = more[head:]
        before = np.cumsum(rest) - rest
        own[head:] = head + np.minimum(tails - 1, (tails * before / rest.sum()).astype(np.int64))
        own = np.unique(own, return_inverse=True)[1]
    size = int(own[-1]) + 1 if len(own) else 0
    mass = np.bincount(own, more, minlength=size) if size else np.zeros(0)
    whole = float(n + v + 1)
    mass = np.append(mass, max(whole - mass.sum(), 1.0))  # every other word, and one unseen
    number = {w: i for i, (w, _) in enumerate(counts)}
    return Vocabulary(number, np.append(own, size), np.append(np.log10(more), 0.0), np.log10(mass), np.log(mass / mass.sum()), n, v)


class Network:
    """A GRU over classes with a two-level softmax. Weights are one flat vector, so that they average and travel easily."""

    def __init__(self, start: np.ndarray, hidden: int = HIDDEN, group: int = GROUP, seed: int = 3, weights: np.ndarray | None = None):
        self.k, self.h, self.g = len(start), hidden, group
        self.groups = -(-self.k // group)
        shapes = {"e": (self.k + 1, 3 * hidden), "u": (hidden, 2 * hidden), "c": (hidden, hidden), "go": (hidden, self.groups), "gb": (self.groups,), "wo": (self.groups * group, hidden), "wb": (self.groups * group,)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.w = np.zeros(size) if weights is None else weights.copy()
        self.slices = shapes
        self.p = self.parts_of(self.w)
        if weights is None:
            rng = np.random.default_rng(seed)
            for name, scale in (("e", 0.3), ("u", 0.3), ("c", 0.3)):  # output weights start at zero: the counts' own shares
                self.p[name][...] = rng.normal(0, scale, self.p[name].shape)
            bias = np.full(self.groups * group, -1e4)
            bias[: self.k] = start
            self.p["wb"][...] = bias
            self.p["gb"][...] = np.log(np.exp(bias.reshape(self.groups, group)).sum(axis=1))

    def step(self, x: np.ndarray, h: np.ndarray):
        """The next state after classes x; also what backpropagation needs."""
        n = self.h
        e = self.p["e"][x]
        zr, c = e[:, : 2 * n], e[:, 2 * n :]
        zr += h @ self.p["u"]
        zr = _sigmoid(zr)
        z, r = zr[:, :n], zr[:, n:]
        rh = r * h
        c += rh @ self.p["c"]
        c = np.tanh(c)
        new = c - h
        new *= z
        new += h
        return new, (x, h, z, r, rh, c)

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Natural log of P(class y | state h) for every row; with grads, adds the gradients of the mean loss and returns that of h."""
        n, rows = self.h, np.arange(len(y))
        order = np.argsort(y.astype(np.int16 if self.k < 1 << 15 else np.int64), kind="stable")  # rows of a group stand together
        y = y.take(order)
        g, inner = np.divmod(y, self.g)
        ht = np.empty((n + 1, len(y)), h.dtype)  # classes by rows, so that sums over classes run along rows; ones meet the biases
        ht[:n], ht[n] = h.take(order, axis=0).T, 1
        a = np.concatenate((self.p["go"].T, self.p["gb"][:, None]), axis=1) @ ht
        a -= a.max(axis=0)
        logs = a[g, rows]
        np.exp(a, out=a)
        scale = a.sum(axis=0)
        # a product for each group, all else for all rows at once
        cut = np.searchsorted(g, np.arange(self.groups + 1)).tolist()
        parts = [(slice(cut[k], cut[k + 1]), slice(k * self.g, (k + 1) * self.g)) for k in range(self.groups) if cut[k] < cut[k + 1]]
        weights, e = np.concatenate((self.p["wo"], self.p["wb"][:, None]), axis=1), np.empty((self.g, len(y)), h.dtype)
        for at, span in parts:
            np.matmul(weights[span], ht[:, at], out=e[:, at])
        e -= e.max(axis=0)
        logs += e[inner, rows]
        np.exp(e, out=e)
        total = e.sum(axis=0)
        logs -= np.log(scale * total)
        back = np.empty_like(order)
        back[order] = rows
        if grads is None:
            return logs.take(back), None
        a /= scale
        a[g, rows] -= 1
        e /= total
        e[inner, rows] -= 1
        of_group, of_class, dh = a @ ht.T, np.zeros_like(weights), np.empty((n, len(y)), h.dtype)
        for at, span in parts:
            np.matmul(e[:, at], ht[:, at].T, out=of_class[span])
            np.matmul(self.p["wo"][span].T, e[:, at], out=dh[:, at])
        grads["go"] += of_group[:, :n].T
        grads["gb"] += of_group[:, n]
        grads["wo"] += of_class[:, :n]
        grads["wb"] += of_class[:, n]
        dh += self.p["go"] @ a
        return logs.take(back), np.ascontiguousarray(dh.T).take(back, axis=0)

    def run(self, x: np.ndarray, h: np.ndarray):
        """States before and after each step of x (steps by rows) from h; also the gates, the gated states and the candidates of all steps.

        They are made and lie in memory as steps by features by rows, so that the parts of a step are whole runs.
        """
        n, (steps, rows) = self.h, x.shape
        e = self.p["e"].copy()
        e[:, : 2 * n] *= -1  # a sigmoid is 1 / (1 + exp(-x))
        e = np.ascontiguousarray(e.take(x.reshape(-1), axis=0).reshape(steps, rows, 3 * n).transpose(0, 2, 1))
        gates, c, u, w = e[:, : 2 * n], e[:, 2 * n :], np.ascontiguousarray(-self.p["u"].T), np.ascontiguousarray(self.p["c"].T)
        states, gated = np.empty((steps + 1, n, rows), h.dtype), np.empty((steps, n, rows), h.dtype)
        to_gates, to_c = np.empty((2 * n, rows), h.dtype), np.empty((n, rows), h.dtype)
        states[0] = h.T
        with np.errstate(over="ignore"):  # a gate is zero then
            for h, new, zr, own, reset in zip(states, states[1:], gates, c, gated, strict=False):
                zr += np.dot(u, h, out=to_gates)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.multiply(zr[n:], h, out=reset)
                own += np.dot(w, reset, out=to_c)
                np.tanh(own, out=own)
                np.subtract(own, h, out=new)
                new *= zr[:n]
                new += h
        return tuple(a.transpose(0, 2, 1) for a in (states, gates, gated, c))

    def train_window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, grads: dict) -> tuple[np.ndarray, float, int]:
        """Gradients of one window by backpropagation to its start; x, y: steps by rows, y -1 where a text has ended."""
        n, (steps, rows) = self.h, x.shape
        made = self.run(x, h)
        states, gates, gated, c = (a.transpose(0, 2, 1) for a in made)
        after, flat = made[0][1:].reshape(-1, n), y.reshape(-1)
        on = np.flatnonzero(flat >= 0)
        if len(on) == len(flat):
            loss, d = self.log_probs(after, flat, grads)
        else:
            d = np.zeros_like(after)
            loss, d[on] = self.log_probs(after.take(on, axis=0), flat.take(on), grads)
        d = np.ascontiguousarray(d.reshape(steps, rows, n).transpose(0, 2, 1))
        # what does not depend on later steps, for all steps at once: of the candidate, what stays, of both gates, the reset
        # gate; each is then multiplied in its place by the gradient that it meets
        z, r, before = gates[:, :n], gates[:, n:], states[:-1]
        m = np.empty((steps, 5, n, rows), h.dtype)
        of_c, stay, of_z, of_r, reset = (m[:, i] for i in range(5))
        np.subtract(1, z, out=stay)
        np.subtract(c, before, out=of_z)
        of_z *= z
        of_z *= stay
        np.multiply(c, c, out=of_c)
        np.subtract(1, of_c, out=of_c)
        of_c *= z
        np.subtract(1, r, out=of_r)
        of_r *= r
        of_r *= before
        reset[...] = r
        one = np.eye(n, dtype=h.dtype)
        wt, ut = np.ascontiguousarray(self.p["c"]), np.concatenate((one, self.p["u"], one), axis=1)
        back, drh = np.zeros((n, rows), h.dtype), np.empty((n, rows), h.dtype)
        for dh, own in zip(d[::-1], m[::-1], strict=True):
            dh += back
            own[:3] *= dh
            own[3:] *= np.dot(wt, own[0], out=drh)
            np.dot(ut, own[1:].reshape(4 * n, rows), out=back)
        dg = np.empty((steps, rows, 3 * n), h.dtype)
        dg[:, :, : 2 * n] = m[:, 2:4].reshape(steps, 2 * n, rows).transpose(0, 2, 1)
        dg[:, :, 2 * n :] = of_c.transpose(0, 2, 1)
        dg = dg.reshape(-1, 3 * n)
        grads["u"] += before.transpose(1, 0, 2).reshape(n, -1) @ dg[:, : 2 * n]
        grads["c"] += gated.transpose(1, 0, 2).reshape(n, -1) @ dg[:, 2 * n :]
        # of equal inputs together
        seen = x.reshape(-1)
        order = np.argsort(seen.astype(np.int16 if self.k < 1 << 15 else np.int64), kind="stable")
        ordered = seen.take(order)
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        grads["e"][ordered.take(first)] += np.add.reduceat(dg.take(order, axis=0), first, axis=0)
        return made[0][-1], -float(loss.sum()), len(on)

    def parts_of(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The weights' names and shapes for another vector of their size."""
        out, at = {}, 0
        for name, shape in self.slices.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def windows(texts: list[np.ndarray], none: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of texts that are read side by side, longest first: inputs and classes to come, steps by rows.

    Only the texts that reach a window are in it, so it is in memory and never the group up to its longest text.
    none: the input before a text's first class, and after its end, where the class to come is -1.
    """
    sizes = np.array([len(t) for t in texts])
    words, start, last = np.concatenate(texts), np.cumsum(sizes) - sizes, np.full(len(texts), none)
    for a in range(0, int(sizes[0]), WINDOW):
        live = int(np.searchsorted(-sizes, -a, side="left"))
        own, at = sizes[:live], np.arange(a, min(a + WINDOW, int(sizes[0])))[:, None]
        place = at + start[:live]
        if own[-1] > at[-1, 0]:
            y = words.take(place)
        else:
            y = np.where(at < own, words.take(np.minimum(place, start[:live] + own - 1)), -1)
        x = np.concatenate((last[None, :live], y[:-1]))
        last = y[-1]
        yield np.where(x < 0, none, x), y


def train(network: Network, texts: list[np.ndarray], rate: float = RATE, rows: int = ROWS, seed: int = 0) -> int:
    """Adam over windows of the texts' classes, each text read from its start with its state carried; tokens seen."""
    first, second, flat = np.zeros_like(network.w), np.zeros_like(network.w), np.empty_like(network.w)
    grads = network.parts_of(flat)
    seen = steps = 0
    order = np.argsort([len(t) for t in texts], kind="stable")
    groups = [order[i : i + rows] for i in range(0, len(order), rows)]
    np.random.default_rng(seed).shuffle(groups)
    for own in groups:
        h = np.zeros((len(own), network.h), network.w.dtype)
        for x, y in windows([texts[i] for i in own[::-1]], network.k):
            flat[...] = 0
            h, _, n = network.train_window(x, y, h[: x.shape[1]], grads)
            flat /= max(n, 1)
            norm = float(np.sqrt(flat @ flat))
            if norm > 1:
                flat /= norm
            steps += 1
            seen += n
            first *= 0.9
            first += 0.1 * flat
            flat *= flat
            flat *= 0.01
            second *= 0.99
            second += flat
            np.multiply(second, 1 / (1 - 0.99**steps), out=flat)
            np.sqrt(flat, out=flat)
            flat += 1e-6
            np.divide(first, flat, out=flat)
            flat *= rate / (1 + steps / 400) / (1 - 0.9**steps)
            network.w -= flat
    return seen


def log_likelihoods(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of every text's classes, window by window with the state carried to the end of the text."""
    out = np.zeros(len(texts))
    order = np.argsort([-len(t) for t in texts], kind="stable")
    for i in range(0, len(order), SCORE_ROWS):
        own = order[i : i + SCORE_ROWS]
        h = np.zeros((len(own), network.h), network.w.dtype)
        for x, y in windows([texts[j] for j in own], network.k):
            live = x.shape[1]
            states = network.run(x, h[:live])[0]
            h, after, flat = states[-1], states[1:].reshape(-1, network.h), y.reshape(-1)
            on = np.flatnonzero(flat >= 0)
            logs, _ = network.log_probs(after.take(on, axis=0), flat.take(on))
            out[own[:live]] += np.bincount(on % live, logs, live)
    return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def text_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts of all batches in runs of bounded size."""
    for batch in batches:
        texts = batch.column("text")
        for a, b in row_parts(len(texts), byte_sizes(texts), BATCH_BYTES):
            yield texts.slice(a, b - a)


def word_counts(docs: DataFrame) -> DataFrame:
    """w (binary), c: how often each token occurs in the texts, the end of a text as the empty word; counted per part of a task first."""

    def count(batches):
        for texts in text_parts(batches):
            words = all_space_words(texts)[0].cast(pa.binary()).value_counts()
            yield pa.RecordBatch.from_arrays([words.field(0), words.field(1).cast(pa.int64())], names=["w", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([len(texts)], pa.int64())], names=["w", "c"])

    return docs.select("text").mapInArrow(count, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def fit(docs: DataFrame, counts: DataFrame, known_words: int = KNOWN_WORDS, rounds: int = ROUNDS, rate: float = RATE) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and weights. docs: the training documents (doc_id, text); counts: their words, written once."""
    spark = docs.sparkSession
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count that leaves no more words than wanted: from a histogram of a few thousand bins, as a limit would
    # send that many words of each partition to the driver
    bin_ = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    least, met = 64, 0  # words of one occurrence stand for words that training has not met, in the class of all others
    for r in sorted(counts.groupBy(bin_.alias("b")).count().collect(), key=lambda r: -r.b):
        met += r["count"]
        if met > known_words:
            least = max(least, r.b + 1)
            break
    known = [(bytes(r.w), r.c) for r in counts.where(bin_ >= least).collect()]
    words = vocabulary(known, int(n), int(v))
    network = Network(words.start)
    if not known:
        return words, network.w
    shared = share(spark, words)
    # a network for each task of the scan, or of a few of its parts if they are small: no text is shuffled
    dealt = docs.select("text").coalesce(int(max(1, n // SHARD_TOKENS)))
    for rounds_done in range(rounds):
        now = share(spark, network.w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Network(shared.value.start, weights=now.value.astype(np.float32))
            seen, group, size = 0, [], 0

            def learn():
                slower = (1 + rounds_done) * (1 + seen / SHARD_TOKENS)
                return train(own, group, rate / slower, seed=seen)

            reader = Reader(shared.value)
            for texts in text_parts(batches):
                tokens = reader.read(texts)
                for text in np.split(shared.value.classes[tokens.ids], tokens.starts[1:]):
                    group.append(text)
                    size += len(text)
                    if size > TRAIN_TOKENS:
                        seen += learn()
                        group, size = [], 0
            if group:
                seen += learn()
            part = TaskContext.get().partitionId() % 32
            total = own.w.astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["part", "w", "n"])

        def add(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for batch in rows:
                for w, m in zip(batch.column("w").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    total, n = total + np.frombuffer(w), n + m
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["w", "n"])

        made = dealt.mapInArrow(run, "part bigint, w binary, n bigint").groupBy("part").applyInArrow(add, "w binary, n bigint").collect()
        total = sum(x.n for x in made)
        if not total:
            break
        network.w[...] = sum(np.frombuffer(bytes(x.w)) for x in sorted(made, key=lambda x: bytes(x.w)) if x.n) / total
    return words, network.w


def numbers(words: Vocabulary, tokens: list[bytes]) -> np.ndarray:
    """Numbers of the tokens and of the text's end; the last number is that of words which are not known."""
    get, other = words.number.get, len(words.number)
    return np.fromiter(map(get, chain(tokens, (END,)), repeat(other)), np.int64, len(tokens) + 1)


def classes(words: Vocabulary, tokens: list[bytes]) -> np.ndarray:
    return words.classes[numbers(words, tokens)]


class Tokens(NamedTuple):
    """Tokens of some texts, one text after another, each with its end."""

    ids: np.ndarray  # numbers of the tokens; the last number is that of words which are not known
    starts: np.ndarray  # where each text begins
    rows: np.ndarray  # of each token that is not known: its text
    strange: pa.Array  # and the token


class Reader:
    """`numbers` for many texts at once, by Arrow."""

    def __init__(self, words: Vocabulary):
        self.known, self.other = pa.array(list(words.number), pa.binary()), len(words.number)
        self.end = words.number.get(END, self.other)

    def read(self, texts: pa.Array) -> Tokens:
        words, sizes = all_space_words(texts)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        found = pc.fill_null(pc.index_in(words, value_set=self.known.cast(words.type)), self.other).to_numpy()
        ids = np.full(len(words) + len(sizes), self.end)
        ids[np.arange(len(words)) + rows] = found  # each text before it has an end
        strange = np.flatnonzero(found == self.other)
        rows, strange = rows[strange], words.take(pa.array(strange)).cast(pa.binary())
        if self.end == self.other:
            rows, strange = np.concatenate((rows, np.arange(len(sizes)))), pa.concat_arrays([strange, pa.array([END] * len(sizes), pa.binary())])
        return Tokens(ids, np.cumsum(sizes + 1) - sizes - 1, rows, strange)


def bags(rows: np.ndarray, words: pa.Array, n: int) -> pa.Array:
    """For each of n rows, its different words with their numbers."""
    t = pa.table({"row": rows, "w": words}).group_by(["row", "w"], use_threads=False).aggregate([([], "count_all")]).sort_by("row").combine_chunks()
    row, w, c = (pa.concat_arrays(t.column(k).chunks) if t.num_rows else pa.array([], t.column(k).type) for k in ("row", "w", "count_all"))
    at = np.searchsorted(row.to_numpy(), np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([w, c.cast(pa.int64())], ["w", "n"]))


@apart
def score(docs: DataFrame, words: Vocabulary, weights: np.ndarray, counts: DataFrame) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score to every row.

    docs: a column text, any others. base_score is the add-one unigram log10 probability of the text and its end by the
    training counts; score is the network's. Null and empty texts are their end alone. Repeated rows score alike; an
    empty table gives an empty result; without training tokens every token is unseen.
    """
    spark = docs.sparkSession
    ship(spark)
    shared, net = share(spark, words), share(spark, weights)
    df = without(docs, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    keep = [c for c in df.columns if c != "text" or "text" in docs.columns]

    def run(batches):
        own = shared.value
        network = Network(own.start, weights=net.value.astype(np.float32))
        reader = Reader(own)
        task, row = TaskContext.get().partitionId(), 0
        for whole in batches:
            for a, b in row_parts(whole.num_rows, byte_sizes(whole.column("text")), BATCH_BYTES):
                batch = whole.slice(a, b - a)
                ids, starts, strange_rows, strange = reader.read(batch.column("text"))
                in_class = own.classes[ids]
                tokens = np.diff(starts, append=len(ids))
                known = tokens - np.bincount(strange_rows, minlength=b - a)
                logs = np.add.reduceat(own.log_count[ids], starts)
                fixed = logs - np.add.reduceat(own.log_mass[in_class], starts)
                like = log_likelihoods(network, np.split(in_class, starts[1:])) / np.log(10)
                made = [pa.array([task] * (b - a), pa.int64()), pa.array(range(row, row + b - a), pa.int64()), *map(pa.array, (tokens, known, logs, like + fixed)), bags(strange_rows, strange, b - a)]
                row += b - a
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, *names])

    names = ["__lg_task", "__lg_row", "__lg_tokens", "__lg_known", "__lg_logs", "__lg_like", "__lg_bag"]
    fields = "__lg_task bigint, __lg_row bigint, __lg_tokens bigint, __lg_known bigint, __lg_logs double, __lg_like double, __lg_bag array<struct<w:binary,n:bigint>>"
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(fields).fields)
    # written once, so that a row's number is the same wherever it is joined
    rows = materialise(df.mapInArrow(run, schema), "scored")
    # words that are not known: their counts, joined by word and summed by row
    strange = rows.select("__lg_task", "__lg_row", F.explode("__lg_bag").alias("b")).select("__lg_task", "__lg_row", "b.w", "b.n")
    met = strange.join(counts, "w").groupBy("__lg_task", "__lg_row").agg(F.sum("n").alias("__lg_met"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("__lg_more"))
    out = rows.join(met, ["__lg_task", "__lg_row"], "left")
    more, whole = F.coalesce("__lg_more", F.lit(0.0)), float(np.log10(words.n + words.v + 1.0))
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("__lg_tokens").alias("n_tokens"),
        (F.col("__lg_known") + F.coalesce("__lg_met", F.lit(0))).alias("n_known"),
        F.lit(words.n).cast("bigint").alias("train_tokens"),
        (F.col("__lg_logs") + more - F.col("__lg_tokens") * whole).alias("base_score"),
        (F.col("__lg_like") + more).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"))
    training = docs.where(~out)
    counts = materialise(word_counts(training), "counts")
    words, weights = fit(training, counts)
    scored = score(docs.withColumn("held_out", out), words, weights, counts)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
