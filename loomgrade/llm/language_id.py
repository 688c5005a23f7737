"""Operator 12, language identification by interpolated Kneser-Ney models of characters, one a language.

Texts become runs of lower-case letters with one space between. A language's model holds, for each run of up to ORDER
characters, log p(last | before) and, for contexts, what an unseen continuation is multiplied by; lower orders count in how many
different contexts a run stands, not how often. All runs of all languages stand in one sorted array of hashes an
order, with a column a language, so a character costs one look-up whatever the number of languages: a run that some
language knows holds every language's finished probability, back-off included. The least cross-entropy a character
wins; how far it lies ahead, in nats over the whole text, is calibrated to a probability on a fold of the training rows, and a
text whose cross-entropy lies beyond nearly all of that fold's, for its language, is rejected.

Counts are made by Spark; learning reads a bounded sample of the training rows (`CHARS` characters of all languages, by a
hash of rows), so the broadcast is bounded: a row of the arrays takes 8 bytes and 8 more a language.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrade.llm.common import apart, append_columns, share, without
from loomgrade.session import materialise, ship, table

ORDER = 5
NONE = "und"
CHARS = 8 << 20  # characters that are learnt from, over all languages
MODEL_BYTES = 512 << 20  # of the arrays, at most: with very many languages fewer characters are learnt from
LONGEST = 1 << 20  # a text of more characters is not learnt from
FOLD_ROWS = 20_000  # rows of the fold that calibrates
SLICE = 1 << 18  # characters that are scored at once
DIRECTORY = 20  # bits of a hash that find its place in the sorted array
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(16)], np.uint64)


class _Characters:
    """Code points to lower case, and which of them are parts of words; made from Unicode's own tables, once a process."""

    made = None

    def __init__(self):
        n = 0x110000
        kinds = [unicodedata.category(chr(i)) for i in range(n)]
        self.part = np.array([k[0] in "LM" for k in kinds])
        self.letter = np.array([k[0] == "L" for k in kinds])
        self.low = np.arange(n, dtype=np.uint32)
        for i in np.flatnonzero([k in ("Lu", "Lt") for k in kinds]).tolist():
            low = chr(i).lower()
            if len(low) == 1:
                self.low[i] = ord(low)


def characters() -> _Characters:
    if _Characters.made is None:
        _Characters.made = _Characters()
    return _Characters.made


def runs_of(text: str, order: int, slice_chars: int = SLICE) -> Iterator[tuple[np.ndarray, bool]]:
    """The normalised characters of a text in slices, each led by the order - 1 characters before it, and whether it has letters.

    A text begins behind order - 1 spaces and ends with one.
    """
    c = characters()
    before, letters = np.full(order - 1, 32, np.uint32), False
    for a in range(0, len(text), slice_chars):
        x = np.frombuffer(text[a : a + slice_chars].encode("utf-32-le", "surrogatepass"), np.uint32)
        part = c.part[x]
        letters = letters or bool(c.letter[x].any())
        x = np.where(part, c.low[x], 32).astype(np.uint32)
        joined = np.concatenate([before[-1:], x])
        x = x[(joined[1:] != 32) | (joined[:-1] != 32)]
        if len(x):
            whole = np.concatenate([before, x])
            yield whole, letters
            before = whole[len(whole) - order + 1 :]
    if letters and before[-1] != 32:
        yield np.concatenate([before, np.array([32], np.uint32)]), True


def hashes(chars: np.ndarray, ends: np.ndarray | None, k: int) -> np.ndarray:
    """Hashes of the runs of k characters that end at `ends`, or at each place that has k characters up to it."""
    h = np.zeros(len(chars) - k + 1 if ends is None else len(ends), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            x = chars[k - 1 - j : len(chars) - j] if ends is None else chars[ends - j]
            h += (x.astype(np.uint64) + np.uint64(1)) * _POWERS[j]
        h = (h ^ (h >> np.uint64(32)) ^ np.uint64(k)) * _POWERS[1]
        return h ^ (h >> np.uint64(29))


class SortedHashes:
    """Places of hashes in a sorted array, found by a directory of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(DIRECTORY, max(1, int(len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        top = (h >> self.shift).astype(np.int64)
        at, end = self.starts[top], self.starts[top + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            found = self.keys[at[live]] == h[live]
            out[live[found]] = at[live[found]]
            live = live[~found]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


class Models:
    """The languages' models: for each order sorted hashes, and log p and log back-off a language."""

    def __init__(self, langs: list[str], keys: list[np.ndarray], logp: list[np.ndarray], back: list[np.ndarray], unseen: np.ndarray):
        self.langs, self.order, self.unseen = langs, len(keys), unseen
        self.hashes, self.logp, self.back = [SortedHashes(k) for k in keys], logp, back
        self.curve, self.limits = (0.0, 0.0), np.zeros((len(langs), 3))
        self.bar = math.inf

    @property
    def bytes(self) -> int:
        return sum(h.keys.nbytes + h.starts.nbytes + p.nbytes + b.nbytes for h, p, b in zip(self.hashes, self.logp, self.back, strict=True))

    def char_scores(self, chars: np.ndarray) -> np.ndarray:
        """log p of each character behind the first order - 1, for each language."""
        order = self.order
        at = self.hashes[-1].find(hashes(chars, None, order))
        out = self.logp[-1][np.maximum(at, 0)]
        live = np.flatnonzero(at < 0)
        out[live] = 0
        for k in range(order - 1, -1, -1):  # what no language knows is taken one character shorter, at the price of the back-off
            if not len(live):
                break
            ends = live + order - 1
            if k:
                at = self.hashes[k - 1].find(hashes(chars, ends - 1, k))
                out[live[at >= 0]] += self.back[k - 1][at[at >= 0]]
                at = self.hashes[k - 1].find(hashes(chars, ends, k))
                out[live[at >= 0]] += self.logp[k - 1][at[at >= 0]]
                live = live[at < 0]
            else:
                out[live] += self.unseen
        return out

    def text_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of log p a text and language, scored characters, and whether there are letters."""
        n = len(texts)
        sums, chars, letters = np.zeros((n, len(self.langs))), np.zeros(n, np.int64), np.zeros(n, bool)
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0

        def flush():
            nonlocal held, owners, size
            if held:
                # slices are scored as one run; the characters that lead a slice get no score
                scores = self.char_scores(np.concatenate(held))
                total = np.vstack([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
                a = 0
                for x, i in zip(held, owners, strict=True):
                    m = len(x) - self.order + 1
                    sums[i] += total[a + m] - total[a]
                    chars[i] += m
                    a += len(x)
            held, owners, size = [], [], 0

        for i, text in enumerate(texts):
            for x, some in runs_of(text or "", self.order):
                letters[i] |= some
                held.append(x)
                owners.append(i)
                size += len(x)
                if size > SLICE:
                    flush()
        flush()
        return sums, chars, letters


    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, calibrated score, cross-entropy a character and whether it is rejected, for each text."""
        if not self.langs:
            return [(NONE, 0.0, None, True)] * len(texts)
        sums, chars, letters = self.text_scores(texts)
        best, margin = sums.argmax(axis=1), _margins(sums)
        out = []
        for i in range(len(texts)):
            if not letters[i]:
                out.append((NONE, 0.0, None, True))
                continue
            entropy = -sums[i, best[i]] / chars[i]
            score = 1 / (1 + math.exp(-min(30, self.curve[0] + self.curve[1] * math.log1p(margin[i]))))
            out.append((self.langs[best[i]], score, float(entropy), bool(self.surprise(best[i], entropy, chars[i]) > self.bar)))
        return out

    def surprise(self, lang, entropy, chars):
        """How many standard deviations a cross-entropy lies above its language's, for texts of this length."""
        mean, own, more = self.limits[lang].T
        return (entropy - mean) / np.sqrt(own + more / chars + 1e-9)

    def calibrate(self, langs: np.ndarray, sums: np.ndarray, chars: np.ndarray, reject: float) -> None:
        """The curve from margins to the share of right answers, and the bar of rejection, from texts of known languages."""
        if not len(langs):
            return
        x, right = np.log1p(_margins(sums)), sums.argmax(axis=1) == langs
        # two made-up texts, one right and one wrong at no margin, keep the curve finite where no answer is wrong
        x, y = np.append(x, [0, 0]), np.append(right, [1, 0]).astype(float)
        w, ones = np.zeros(2), np.stack([np.ones(len(x)), x], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-ones @ w))
            w = w + np.linalg.solve((ones * (p * (1 - p))[:, None]).T @ ones + 1e-3 * np.eye(2), ones.T @ (y - p) - 1e-3 * w)
        self.curve = (float(w[0]), float(max(w[1], 0)))
        entropy = -sums[np.arange(len(langs)), langs] / chars
        for k in range(len(self.langs)):
            e, n = entropy[langs == k], chars[langs == k]
            mean = float(np.average(e, weights=n)) if len(e) else math.log(1 << 21)
            spread = np.stack([np.ones(len(e)), 1 / n], axis=1)
            own, more = np.maximum(np.linalg.lstsq(spread, (e - mean) ** 2, rcond=None)[0], 0) if len(e) > 2 else (1.0, 1.0)
            self.limits[k] = mean, own, more
        self.bar = float(np.quantile(self.surprise(langs, entropy, chars), 1 - reject))


def _margins(sums: np.ndarray) -> np.ndarray:
    """How far the best language lies ahead, over the whole text; 0 where there is only one."""
    if sums.shape[1] < 2:
        return np.zeros(len(sums))
    two = np.partition(sums, -2, axis=1)[:, -2:]
    return two[:, 1] - two[:, 0]


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram (`order` characters), n of docs (lang, text); each task counts part by part before anything is shuffled."""
    ship(docs.sparkSession)

    def counted(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, order) for x in parts])
            own = np.concatenate([hashes(x, None, order) for x in parts])
            _, at, n = np.unique(own, return_index=True, return_counts=True)
            flat = rows[at].tobytes().decode("utf-32-le", "surrogatepass")
            grams = pa.array([flat[i : i + order] for i in range(0, len(flat), order)])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), grams, pa.array(n)], names=["lang", "gram", "n"])

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for x, _ in runs_of(text or "", order):
                    held.setdefault(lang, []).append(x)
                    size += len(x)
                    if size > 4 * SLICE:
                        yield from counted(held)
                        held, size = {}, 0
        yield from counted(held)

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(langs: list[str], lang: np.ndarray, grams: np.ndarray, n: np.ndarray) -> Models:
    """Models from counts: lang (index), grams (rows of code points), n. Each (lang, gram) stands once."""
    order, wide = grams.shape[1], len(langs)
    vocabulary = len(np.unique(grams)) + 1
    # from the longest runs to the shortest: counts of the runs, then in how many contexts each shorter one stands
    levels = []
    for k in range(order, 0, -1):
        levels.append((lang, grams, n))
        if k > 1:
            own = np.stack([lang.astype(np.uint64), hashes(grams[:, 1:].reshape(-1), np.arange(len(grams)) * (k - 1) + k - 2, k - 1)], axis=1)
            _, at, n = np.unique(own, axis=0, return_index=True, return_counts=True)
            lang, grams = lang[at], grams[at, 1:]
    keys, logp, back = [], [], []
    unseen = np.full(wide, -math.log(vocabulary))
    for k, (lang, grams, n) in enumerate(reversed(levels), 1):
        flat, ends = np.ascontiguousarray(grams).reshape(-1), np.arange(len(grams)) * k + k - 1
        own = hashes(flat, ends, k)
        key, row = np.unique(own, return_inverse=True)
        context = hashes(flat, ends - 1, k - 1) if k > 1 else np.zeros(len(grams), np.uint64)
        which, slot = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(which), wide)), np.zeros((len(which), wide))
        np.add.at(total, (slot, lang), n)
        np.add.at(kinds, (slot, lang), 1)
        once = np.bincount(lang[n == 1], minlength=wide).astype(float)
        twice = np.bincount(lang[n == 2], minlength=wide)
        discount = np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.75)
        gap = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)  # by which shorter runs count after a context
        if k == 1:
            lower = np.broadcast_to(unseen, (len(key), wide))
            behind = np.broadcast_to(gap[0] if len(gap) else np.ones(wide), (len(key), wide))
            unseen = unseen + np.log(behind[0] if len(key) else np.ones(wide))
        else:
            first = np.zeros(len(key), np.int64)  # a row of each key
            first[row] = np.arange(len(grams))
            suffix = SortedHashes(keys[-1]).find(hashes(flat, ends, k - 1))
            lower = logp[-1][suffix[first]]
            behind = gap[slot[first]]
            # back-off of the contexts, which stand among the runs one shorter; those that do not, before a text's first characters, join them
            at = SortedHashes(keys[-1]).find(which)
            new = np.flatnonzero(at < 0)
            if len(new):
                merged = np.concatenate([keys[-1], which[new]])
                by = np.argsort(merged)
                keys[-1] = merged[by]
                logp[-1] = np.concatenate([logp[-1], np.full((len(new), wide), float(unseen.min()))])[by]
                back[-1] = np.concatenate([back[-1], np.zeros((len(new), wide))])[by]
                at = SortedHashes(keys[-1]).find(which)
            back[-1][at] = np.log(gap)
        p = behind * np.exp(lower)
        p[row, lang] += np.maximum(n - discount[lang], 0) / total[slot, lang]
        keys.append(key)
        logp.append(np.log(p))
        back.append(np.zeros((len(key), wide)))
    return Models(langs, keys, [x.astype(np.float32) for x in logp], [x.astype(np.float32) for x in back], unseen.astype(np.float32))


def fit(training: DataFrame, order: int = ORDER, chars: int = CHARS, reject: float = 0.001) -> Models:
    """Models of the languages of training (lang, text); rows with a null are left out. No rows: a model without languages.

    Learns from a sample of about `chars` characters, equally many of each language as far as it has them, of texts of at most
    LONGEST characters, picked by a hash of the text; fewer where there are so many languages that the arrays would pass
    MODEL_BYTES. A fifth of the sample only calibrates. `reject` is the share of right texts that the bar may reject.
    """
    rows = training.select("lang", "text").where(F.col("lang").isNotNull() & (F.length("text") <= LONGEST))
    sizes = {r.lang: r.size for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("size")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Models([], [np.zeros(0, np.uint64)] * order, [np.zeros((0, 0), np.float32)] * order, [np.zeros((0, 0), np.float32)] * order, np.zeros(0, np.float32))
    each = min(chars, MODEL_BYTES // (8 + 8 * len(langs)) // order) / len(langs)
    spark = training.sparkSession
    most = spark.createDataFrame([(g, int((1 << 40) * min(1.0, each / max(1, sizes[g])))) for g in langs], "lang string, __lg_most bigint")
    picked = rows.join(F.broadcast(most), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < F.col("__lg_most"))
    sample = materialise(picked.select("lang", "text", (F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(5)) == 0).alias("fold")), "language-sample")
    index = {g: i for i, g in enumerate(langs)}
    counts = gram_counts(sample.where("NOT fold"), order).toArrow()
    lang = np.array([index[g] for g in counts.column("lang").to_pylist()], np.int64)
    grams = np.frombuffer("".join(counts.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order)
    models = kneser_ney(langs, lang, grams, counts.column("n").to_numpy().astype(np.int64))
    held = share(spark, models)

    def measure(batches):
        for batch in batches:
            sums, n, letters = held.value.text_scores(batch.column("text").to_pylist())
            some = np.flatnonzero(letters)
            own = [index[g] for g in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in some], pa.int64()), pa.array([sums[i].tolist() for i in some], pa.list_(pa.float64())), pa.array(n[some])], names=["lang", "sums", "n"])

    fold = sample.where("fold").select("lang", "text")
    share_rows = FOLD_ROWS / max(1, fold.count())
    fold = fold.where(F.pmod(F.xxhash64("text", F.lit("some")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, share_rows)))
    found = fold.mapInArrow(measure, "lang bigint, sums array<double>, n bigint").collect()
    if found:
        models.calibrate(np.array([r.lang for r in found]), np.array([r.sums for r in found]), np.array([r.n for r in found]), reject)
    return models


@apart
def identify(docs: DataFrame, models: Models) -> DataFrame:
    """docs (text, any others) with lang_pred, score, cross_entropy and rejected.

    lang_pred: the language whose model is least surprised by a character; ties go to the smaller name. `und` with score
    0 if the text is null, has no letter, or no language was learnt. score: the calibrated probability that lang_pred
    is right. rejected: even the best language is more surprised than by nearly all texts known to be its own; `und` is rejected.
    Whole texts are read, in slices of bounded size. No shuffle; repeated rows get equal results.
    """
    held = share(docs.sparkSession, models)
    names = ["lang_pred", "score", "cross_entropy", "rejected"]

    def make():
        own = held.value

        def rows(batch):
            made = own.judge(batch.column("text").to_pylist())
            return [[m[k] for m in made] for k in range(4)]

        return rows

    return append_columns(without(docs, names), make, "lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = fit(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    judged = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), models)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
