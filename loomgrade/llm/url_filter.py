"""Operator 2, URL filters: a weighted vocabulary found by one Aho-Corasick automaton, below allow and block rules.

A url is rejected for one strict term, or for distinct soft terms of enough weight together. Rules of host and path
come first: the longest rule that fits decides. Rules are probed by hashed lookups of a url's own host suffixes and
path prefixes of the rules' lengths, so their number does not matter. Nothing shuffles; vocabulary and rules are
parameters of the program.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from loomgrade.llm.common import LOWER, apart, append_columns, as_bytes, without
from loomgrade.session import table

#: One of these is enough.
STRICT = ("casino", "cheap-pills", "malware", "porn", "spam-farm", "viagra", "warez", "xxx")
#: Several different ones of these are needed, by weight.
SOFT = {"adult": 1.0, "bet": 1.0, "bonus": 1.0, "cheap": 1.0, "dating": 1.0, "deal": 0.5, "free": 0.5, "loan": 1.0, "pills": 1.0, "poker": 1.0, "spam": 1.0, "win": 0.5}
SOFT_LIMIT = 2.0


@dataclass(frozen=True)
class Rules:
    """host, path and verdict of each rule; the path begins with a slash."""

    rows: tuple[tuple[str, str, str], ...]
    by_key: dict = field(init=False, repr=False, compare=False)
    lengths: tuple = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "by_key", {(h, p): v for h, p, v in self.rows})
        object.__setattr__(self, "lengths", tuple(sorted({len(p) for _, p, _ in self.rows}, reverse=True)))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, by the length of host and path together, and its verdict."""
        best = None
        labels = host.split(".")
        for i in range(len(labels)):
            own = ".".join(labels[i:])
            for n in self.lengths:
                if n <= len(path) and (own, path[:n]) in self.by_key and (best is None or len(own) + n > len(best[0])):
                    best = (own + path[:n], self.by_key[own, path[:n]])
        return best


RULES = Rules((("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    m = next((i for i, c in enumerate(rest) if i >= n and c in "?#"), len(rest))
    return rest[:n].encode().translate(LOWER).decode(), rest[n:m]


class Vocabulary:
    """Strict and soft terms in one automaton. A term counts only between characters that are no ASCII letter or digit."""

    def __init__(self, strict: tuple[str, ...] = STRICT, soft: dict[str, float] | None = None, limit: float = SOFT_LIMIT):
        self.limit = limit
        self.automaton = ahocorasick.Automaton()
        weights = {t.lower(): w for t, w in (SOFT if soft is None else soft).items()} | {t.lower(): float("inf") for t in strict}
        for term, weight in weights.items():
            if term:
                self.automaton.add_word(term, (term, weight))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def judge(self, url: str | None) -> tuple[str, list[str], list[str]]:
        """Verdict, and the distinct strict and soft terms found."""
        text = (url or "").encode().translate(LOWER).decode()
        found = {}
        for end, (term, weight) in () if self.empty else self.automaton.iter(text):
            begin = end - len(term)  # of the character before
            if not (begin >= 0 and _inner(text[begin])) and not (end + 1 < len(text) and _inner(text[end + 1])):
                found[term] = weight
        hard = sorted(t for t, w in found.items() if w == float("inf"))
        soft = sorted(t for t, w in found.items() if w != float("inf"))
        bad = bool(hard) or sum(found[t] for t in soft) >= self.limit and len(soft) > 1
        return "block" if bad else "allow", hard, soft


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


@apart
def filter_urls(pages: DataFrame, vocabulary: Vocabulary | None = None, rules: Rules = RULES, url_col: str = "url") -> DataFrame:
    """Add host, path, rule, strict_terms, soft_terms and verdict (allow or block) to every row.

    A null url, or one without `://`, has an empty host and path and fits no rule; the vocabulary then judges its whole
    text, a null as an empty one. Repeated rows are judged alike; an empty table gives an empty result.
    """
    results = "host string, path string, rule string, strict_terms array<string>, soft_terms array<string>, verdict string"

    def make():
        words = vocabulary or Vocabulary()

        def work(batch):
            rows = []
            for raw in as_bytes(batch.column(url_col)):
                url = None if raw is None else raw.decode()
                host, path = split_url(url)
                verdict, hard, soft = words.judge(url)
                rule = rules.find(host, path)
                rows.append((host, path, rule and rule[0], hard, soft, rule[1] if rule else verdict))
            return [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(6)]

        return work

    return append_columns(without(pages, [c.split()[0] for c in results.split(", ")]), make, results, sized=url_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    url = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    strict = " OR ".join(hit(t) for t in STRICT)
    weight = " + ".join(f"CASE WHEN {hit(t)} THEN {w} ELSE 0 END" for t, w in SOFT.items())
    count = " + ".join(f"CASE WHEN {hit(t)} THEN 1 ELSE 0 END" for t in SOFT)
    fits = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p} {v}'" for h, p, v in sorted(RULES.rows, key=lambda r: -len(r[0] + r[1]))
    )
    return f"""
WITH a AS (SELECT page_id, {url} AS u, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {fits} END AS r, CASE WHEN {strict} OR (({weight}) >= {SOFT_LIMIT} AND ({count}) > 1) THEN 'block' ELSE 'allow' END AS v FROM b)
SELECT page_id, host, path, split_part(r, ' ', 1) AS rule, coalesce(split_part(r, ' ', 2), v) AS verdict FROM c
"""


SQL = _sql()
