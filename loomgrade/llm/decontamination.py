"""Operator 1, benchmark decontamination: a generalised suffix automaton over the words of test items.

The automaton recognises every run of words of every item. Training words are streamed through it; after each word it
knows the longest run of words that ends there and occurs in an item. A run as long as a window marks its words as hit.
Documents never shuffle. Automata are the only broadcast, packed into flat arrays of a few dozen bytes a word of the
items. Items are dealt into blocks of `block_words` words, an automaton each, so that building one takes bounded memory;
automata of up to `pass_bytes` together are broadcast, and beyond that documents pass more than once.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrade.llm.common import alnum_words, apart, append_columns, as_bytes, share, without
from loomgrade.session import materialise, table

WINDOW = 13
COVERAGE = 0.05
BLOCK_WORDS = 250_000  # words of items in an automaton, about
PASS_BYTES = 256 << 20  # packed automata that are broadcast together


class _Builder:
    """Transitions of a growing automaton as a dict a state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy


def _packed(numbers) -> array:
    return array("i", np.asarray(numbers, np.int32).tobytes())


def _groups(pairs: list[tuple], states: int) -> tuple[array, list]:
    """Values by state, each once: where a state's values begin, and all values."""
    pairs = sorted(set(pairs))
    return _packed(np.searchsorted([v for v, *_ in pairs], np.arange(states + 1)) if pairs else np.zeros(states + 1)), [x for _, *x in pairs]


class SuffixAutomaton:
    """All runs of words of a set of items, packed; items shorter than `window` count only as a whole."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.shortest = window, window
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items if i is not None}) + [None]
        number = {n: k for k, n in enumerate(self.names)}
        made, ends, shorts = _Builder(), [], []
        for item, words in items:
            last = 0
            for i, w in enumerate(words, 1):
                last = made.extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                if i >= window:
                    ends.append((last, number[item]))
            if 0 < len(words) < window:
                shorts.append((last, len(words), number[item]))
                self.shortest = min(self.shortest, len(words))
        n = len(made.next)
        link, length = made.link, made.length
        # the state of the last `window` words, and the nearest state that has whole short items
        at_window, at_short = [-1] * n, [-1] * n
        whole = {v for v, _, _ in shorts}
        for v in sorted(range(1, n), key=lambda v: length[v]):
            up = link[v]
            if length[v] >= window:
                at_window[v] = v if length[up] < window else at_window[up]
            at_short[v] = v if v in whole else at_short[up]
        self.link, self.length = _packed(link), _packed(length)
        self.at_window, self.at_short = _packed(at_window), _packed(at_short)
        # what ends in a state ends in the state of its last `window` words
        self.end_at, ended = _groups([(at_window[v], k) for v, k in ends], n)
        self.ends = _packed([k for (k,) in ended])
        self.short_at, self.shorts = _groups(shorts, n)
        self.begin = _packed(np.cumsum([0, *map(len, made.next)]))
        self.word, self.to = array("i"), array("i")
        for v in range(n):
            for w, to in sorted(made.next[v].items()):
                self.word.append(w)
                self.to.append(to)
            made.next[v] = {}

    @property
    def bytes(self) -> int:
        """About what it takes in memory."""
        arrays = (self.link, self.length, self.at_window, self.at_short, self.end_at, self.ends, self.short_at, self.begin, self.word, self.to)
        return sum(a.itemsize * len(a) for a in arrays) + sum(100 + len(w) for w in self.vocabulary) + 150 * len(self.names) + 150 * len(self.shorts)

    def _step(self, v: int, w: int) -> int:
        """The state after word w, -1 if there is none."""
        a, b = self.begin[v], self.begin[v + 1]
        i = bisect_left(self.word, w, a, b)
        return self.to[i] if i < b and self.word[i] == w else -1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit spans as half-open word offsets, the items that occur, and the longest match."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        # a word that no item has resets the automaton, so only long enough runs of known words can match
        gaps = np.concatenate(([-1], np.flatnonzero(ids < 0), [len(ids)]))
        spans: list[tuple[int, int]] = []
        found: set = set()
        longest = 0
        for k in np.flatnonzero(np.diff(gaps) > self.shortest):
            begin = int(gaps[k]) + 1
            longest = max(longest, self._run(ids[begin : gaps[k + 1]].tolist(), begin, spans, found))
        return spans, {self.names[k] for k in found}, longest

    def _run(self, ids: list[int], begin: int, spans: list[tuple[int, int]], found: set) -> int:
        step, link, length, window = self._step, self.link, self.length, self.window
        v = size = longest = 0
        for i, w in enumerate(ids, begin + 1):
            to = step(v, w)
            if to < 0:
                while v and to < 0:
                    v = link[v]
                    to = step(v, w)
                if to < 0:
                    size = 0
                    continue
                size = length[v]
            size += 1
            v = to
            if size > longest:
                longest = size
            if size >= window:
                spans.append((i - window, i))
                top = self.at_window[v]
                found.update(self.ends[self.end_at[top] : self.end_at[top + 1]])
            short = self.at_short[v]
            while short != -1:  # only the state itself can hold items longer than what has matched
                for n, item in self.shorts[self.short_at[short] : self.short_at[short + 1]]:
                    if n <= size:
                        spans.append((i - n, i))
                        found.add(item)
                short = self.at_short[link[short]]
        return longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """`text` without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def automata(benchmark: DataFrame, window: int, block_words: int, pass_bytes: int) -> Iterator[list[SuffixAutomaton]]:
    """Automata of at most about `block_words` words of items each, as many together as may be broadcast."""
    words = F.length("text") / 4 + 1
    total = benchmark.agg(F.sum(F.coalesce(words, F.lit(0.0)))).first()[0] or 0
    blocks = max(1, int(-(-total // block_words)))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    held: list[SuffixAutomaton] = []
    for b in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        made = SuffixAutomaton([(r.item, alnum_words((r.text or "").encode())) for r in own.distinct().collect()], window)
        if held and sum(a.bytes for a in held) + made.bytes > pass_bytes:
            yield held
            held = []
        held.append(made)
    yield held


@apart
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, max_run: int | None = None, action: str = "flag", block_words: int = BLOCK_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Mark, drop or cut documents that hold runs of words of test items.

    docs: a column text, any others; benchmark: item_id, text. A document is contaminated if it has hit words and they
    are at least the share `coverage` of its words, or if `max_run` is given and a matched run is at least that long.
    action: "flag" keeps every row, "drop" leaves out contaminated ones, "cut" takes the hit words out of their text.
    Adds: n_words, n_hit, n_items, items (sorted distinct ids of items that occur), longest_match, contaminated.

    Null and empty texts have no words and are never contaminated. Items without words match nothing; the text of an
    item without an id marks words but is not listed. Repeated rows of either side are judged alike, each by itself;
    an item_id with several texts occurs if one of them does. Empty tables give an empty or an unmarked result.
    """
    if action not in ("flag", "drop", "cut"):
        raise ValueError(f"no such action: {action}")
    spark = docs.sparkSession
    results = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, longest_match bigint, contaminated boolean"
    names = [c.split()[0] for c in results.split(", ")]
    ddl = f"{results}, __lg_spans array<bigint>" + ", __lg_text string" * (action == "cut")
    df = without(docs, names)
    passed = 0
    for held in automata(benchmark, window, block_words, pass_bytes):
        shared = share(spark, held)

        def make(shared=shared, again=passed > 0):
            found_by = shared.value

            def work(batch):
                rows = []
                before = zip(*(batch.column(c).to_pylist() for c in ("__lg_spans", "items", "longest_match")), strict=True) if again else None
                for text in as_bytes(batch.column("text")):
                    words = alnum_words(text)
                    spans, items, longest = [], set(), 0
                    for automaton in found_by:
                        own, more, most = automaton.scan(words)
                        spans, items, longest = spans + own, items | more, max(longest, most)
                    items.discard(None)
                    if before:
                        flat, more, most = next(before)
                        spans, items, longest = spans + list(zip(flat[::2], flat[1::2], strict=True)), items | set(more), max(longest, most)
                    spans = merged(spans)
                    hit = sum(b - a for a, b in spans)
                    bad = hit > 0 and (hit >= coverage * len(words) - 1e-9 or (max_run is not None and longest >= max_run))
                    row = [len(words), hit, len(items), sorted(items), longest, bad, [x for pair in spans for x in pair]]
                    if action == "cut":
                        row.append(text and (cut(text, spans) if bad else text).decode())
                    rows.append(row)
                return [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(7 + (action == "cut"))]

            return work

        made = ("__lg_spans", "__lg_text", *names) if passed else ()
        # a later pass reads what the one before has written, so that one pass's automata at a time are in memory
        df = append_columns(materialise(df, "decontaminate") if passed else df, make, ddl, drop=made)
        passed += 1
    kept = [F.col("__lg_text").alias(c) if action == "cut" and c == "text" else F.col(f"`{c}`") for c in df.columns if not c.startswith("__lg_")]
    out = df.select(*kept)
    return out.where("NOT contaminated") if action == "drop" else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM bw),
dg AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT r, n, p, item_id FROM dg JOIN win USING (n, g)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
