"""Operator 8, line dedup [native]: a segment-partition edit join of lines.

A line is a duplicate if an earlier line, of any document, is within `threshold` edits. Lines of equal text are grouped
first. Each different line of enough characters is split into threshold + 1 segments; a line within the threshold has
one of them unchanged, at a place that the lengths of both bound. Lines probe the segments of lines as long as they are
or up to `threshold` shorter, only at places that can belong to a least alignment. Pairs that meet are verified by the
banded edit distance, cut off beyond the threshold.

A segment that many lines share would bring all their pairs together. Lines of such a segment are split again: what is
left of them without the segment must again have an unchanged segment, so the second probe is as exact as the first,
and so on, level by level, until the groups are small or the rest of the lines is too short to split.

Everything is built-in column functions. Order is document (doc_id, null last; ties by the text's hash), then line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrade.llm.common import apart, without
from loomgrade.session import materialise, table

THRESHOLD = 1
LEAST_CHARS = 24  # more than threshold; shorter lines are duplicates only if they are equal
CROWD = 64  # a segment of more lines is split again


def segments(line: Column, n: Column, k: int) -> list[Column]:
    """Start (from 0) and size of the k segments of a line of n characters; the last ones take what does not divide."""
    base = F.call_function("div", n, F.lit(k)).cast("int")
    longer = n - base * k
    out = []
    for i in range(k):
        before = F.greatest(F.lit(0), longer - (k - i))  # how many of the segments before have a character more
        out.append(((base * i + before).cast("int"), (base + F.when(longer >= k - i, 1).otherwise(0)).cast("int")))
    return out


def probes(k: int) -> list[tuple[int, int, int]]:
    """How a line probes lines shorter by d characters: (d, segment, shift of its start from the segment's own).

    A segment's start can only shift by what edits to its left allow, and by what edits to its right leave over.
    """
    t = k - 1
    return [(d, i, s) for d in range(k) for i in range(k) for s in range(max(-i, d - (t - i)), min(i, d + (t - i)) + 1)]


def _own_keys(line: Column, n: Column, k: int, *salt: Column) -> list[Column]:
    return [F.xxhash64(F.substr(line, a + 1, size), F.lit(i), n, *salt) for i, (a, size) in enumerate(segments(line, n, k))]


def _probe_key(line: Column, n: Column, k: int, d: int, i: int, s: int, *salt: Column) -> Column:
    """For lines of k + d characters at least; a segment shifted by what `probes` allows then lies within the line."""
    a, size = segments(line, n - d, k)[i]
    return F.xxhash64(F.substr(line, a + s + 1, size), F.lit(i), n - d, *salt)


def _rest(line: Column, a: Column, size: Column) -> Column:
    return F.concat(F.substr(line, F.lit(1), a), F.substr(line, a + size + 1))


def _choose(which: Column, options: list[Column]) -> Column:
    out = F.lit(None)
    for i, c in enumerate(options):
        out = F.when(which == i, c).otherwise(out)
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, h, pos, line, n (its length), digest of every line that is not blank. Equal rows of docs count once or more, alike."""
    lines = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    return lines.where(F.trim("line") != "").withColumn("n", F.length("line")).withColumn("digest", F.unhex(F.md5("line")))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h").alias("h"), F.col("pos").alias("pos"))


def _bounded(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """`rows` (of digests or hashes) to be broadcast if they are few, else left to a shuffled join."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _cold_and_hot(own: DataFrame, probe: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Pairs p, q of digests that share a key of few lines, and the rows of keys of many, if any."""
    hot = materialise(own.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowds")
    some = hot.limit(1).count() > 0
    few = _bounded(hot) if some else None
    cold = own.join(few, "key", "left_anti") if some else own
    pairs = probe.select("key", F.col("digest").alias("p")).join(cold.select("key", F.col("digest").alias("q")), "key").where("p <> q").select("p", "q")
    return pairs, (own.join(few, "key", "left_semi") if some else None), (probe.join(few, "key", "left_semi") if some else None)


def duplicate_lines(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Different lines with their first occurrence (digest, first), and the digests of those that an earlier line makes duplicates."""
    k = threshold + 1
    line, n = F.col("line"), F.col("n")
    keys = [F.lit(None)]
    specs = probes(k)
    if threshold:
        long = n >= least_chars
        own = F.when(long, F.array(*_own_keys(line, n, k)))
        tries = {d: [_probe_key(line, n, k, e, i, s) for e, i, s in specs if e <= d] for d in range(k)}
        probe = F.when(~long, None)
        for d in range(k - 1):
            probe = probe.when(n < least_chars + d + 1, F.array(*tries[d]))
        probe = probe.otherwise(F.array(*tries[threshold]))
        keys = [F.any_value(own).alias("own"), F.any_value(probe).alias("probe")]
    lines = occurrences(docs)
    different = materialise(lines.groupBy("digest").agg(F.min(_order()).alias("first"), *(keys if threshold else [])), "lines")
    if not threshold:
        return different, different.select("digest").limit(0)
    own = different.select("digest", F.posexplode("own").alias("at", "key"))
    probe = different.select("digest", F.posexplode("probe").alias("at", "key"))
    pairs, hot_own, hot_probe = _cold_and_hot(own, probe, crowd)
    pairs = materialise(pairs.distinct(), "pairs")
    needed = pairs.select(F.col("p").alias("digest")).unionByName(pairs.select(F.col("q").alias("digest")))
    if hot_own is not None:
        hot_own, hot_probe = materialise(hot_own, "hot"), materialise(hot_probe, "hot")
        needed = needed.unionByName(hot_own.select("digest")).unionByName(hot_probe.select("digest"))
    needed = materialise(needed.distinct(), "needed")
    texts = lines.join(_bounded(needed), "digest", "left_semi").groupBy("digest").agg(F.min(_order()).alias("first"), F.any_value("line").alias("line"))
    texts = materialise(texts, "texts")
    found = [_verified(pairs, texts, threshold)]
    if hot_own is not None:
        found += _crowded(hot_own, hot_probe, texts, threshold, crowd, specs)
    duplicates = found[0]
    for more in found[1:]:
        duplicates = duplicates.unionByName(more)
    return different.select("digest", "first"), duplicates.distinct()


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    left = texts.select(F.col("digest").alias("p"), F.col("first").alias("pf"), F.col("line").alias("pl"))
    right = texts.select(F.col("digest").alias("q"), F.col("first").alias("qf"), F.col("line").alias("ql"))
    near = pairs.join(left, "p").join(right, "q").where(F.levenshtein("pl", "ql", threshold) >= 0)
    return near.select(F.when(F.col("pf") > F.col("qf"), F.col("p")).otherwise(F.col("q")).alias("digest"))


def _crowded(own: DataFrame, probe: DataFrame, texts: DataFrame, threshold: int, crowd: int, specs: list) -> list[DataFrame]:
    """Duplicates among lines that share crowded segments, by splitting what is left of them again and again."""
    k = threshold + 1
    line, n, at = F.col("line"), F.length("line"), F.col("at")
    own = own.join(texts, "digest").select("key", "digest", "first", _choose(at, [_rest(line, *x) for x in segments(line, n, k)]).alias("line"))
    rests, less = [], []
    for d, i, s in specs:
        a, size = segments(line, n - d, k)[i]
        rests.append(_rest(line, a + s, size))
        less.append(F.lit(d))
    probe = probe.join(texts, "digest").select("key", "digest", "first", _choose(at, rests).alias("line"), _choose(at, less).alias("d"))
    found = []
    while True:
        own, probe = materialise(own, "crowd"), materialise(probe, "crowd")
        # a rest too short to be split: few different ones, so least occurrences of each stand for all of its lines
        short = own.where(n <= threshold)
        ends = short.groupBy("key", "line").agg(F.min("first").alias("f"))
        tips = probe.where(n - F.col("d") <= threshold)
        heads = tips.groupBy("key", "line").agg(F.min("first").alias("f"))
        link = heads.select("key", F.col("line").alias("a"), F.col("f").alias("af")).join(ends.select("key", F.col("line").alias("b"), F.col("f").alias("bf")), "key").where(F.levenshtein("a", "b", threshold) >= 0)
        least = link.groupBy("key", "a").agg(F.min("bf").alias("f"))
        found.append(tips.withColumnRenamed("line", "a").join(least, ["key", "a"]).where(F.col("first") > F.col("f")).select("digest"))
        least = link.groupBy("key", "b").agg(F.min("af").alias("f"))
        found.append(short.withColumnRenamed("line", "b").join(least, ["key", "b"]).where(F.col("first") > F.col("f")).select("digest"))
        long = own.where(n > threshold)
        if long.limit(1).count() == 0:
            return found
        own = long.select("digest", "first", "line", F.posexplode(F.array(*_own_keys(line, n, k, F.col("key")))).alias("at", "key"))
        tries = [F.when((F.col("d") == d) & (n - d >= k), _probe_key(line, n, k, d, i, s, F.col("key"))) for d, i, s in specs]
        probe = probe.where(n - F.col("d") > threshold).select("digest", "first", "line", "d", F.posexplode(F.array(*tries)).alias("at", "key")).where("key IS NOT NULL")
        pairs, own, probe = _cold_and_hot(own, probe, crowd)
        found.append(_verified(materialise(pairs.distinct(), "pairs"), texts, threshold))
        if own is None:
            return found
        own = own.select("key", "digest", "first", _choose(at, [_rest(line, *x) for x in segments(line, n, k)]).alias("line"))
        probe = probe.select("key", "digest", "first", "d", _choose(at, [_rest(line, segments(line, n - d, k)[i][0] + s, segments(line, n - d, k)[i][1]) for d, i, s in specs]).alias("line"))


@apart
def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS, crowd: int = CROWD) -> DataFrame:
    """`docs` with duplicate lines taken out of text, and n_lines, n_kept (lines before and after).

    docs: doc_id, text, any others; if there is a column n_chars, it is set to the new text's length. A line stays if it is the first
    of its text and no earlier line is within `threshold` edits (characters inserted, deleted or replaced), whether that
    one stays or not; lines of fewer than `least_chars` characters only meet equal ones. Blank lines always stay.
    A null text stays null and counts as one blank line, as an empty one does. Rows of equal doc_id and text are one
    document and get one result. A document all of whose lines go keeps an empty text. An empty table gives an empty one.
    """
    doc = without(docs, ["n_lines", "n_kept"])
    different, duplicates = duplicate_lines(docs.select("doc_id", "text"), threshold, least_chars, crowd)
    kept = different.join(duplicates, "digest", "left_anti").select("first.none", "first.id", "first.h", "first.pos")
    kept = kept.groupBy(F.col("none").alias("__lg_none"), F.col("id").alias("__lg_id"), F.col("h").alias("__lg_h")).agg(F.collect_list("pos").alias("__lg_kept"))
    own = doc.withColumn("__lg_h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("__lg_none", F.col("doc_id").isNull()).withColumn("__lg_id", F.coalesce("doc_id", F.lit(0)))
    joined = own.join(kept, ["__lg_none", "__lg_id", "__lg_h"], "left").withColumn("__lg_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    blank = F.filter(F.transform("__lg_lines", lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    stays = F.array_sort(F.concat(F.coalesce("__lg_kept", F.array().cast("array<int>")), blank))
    joined = joined.withColumn("__lg_stays", stays)
    text = F.array_join(F.transform("__lg_stays", lambda i: F.get("__lg_lines", i)), "\n")
    joined = joined.withColumn("__lg_text", F.when(F.col("text").isNotNull(), text))
    values = {"text": F.col("__lg_text"), "n_chars": F.length("__lg_text").cast("bigint")}
    return joined.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in doc.columns], F.size("__lg_lines").cast("bigint").alias("n_lines"), F.size("__lg_stays").cast("bigint").alias("n_kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


# brute force over lengths that differ by one at most; the ends that an edit leaves alone make it an equi-join
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT r, (doc_id IS NULL, coalesce(doc_id, 0), text, pos) AS f, pos, lines[pos] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT *, string_split(text, chr(10)) AS lines FROM d))),
u AS (SELECT line, min(f) AS f FROM o WHERE trim(line) <> '' GROUP BY line),
e AS (SELECT line, f, length(line) AS n, left(line, 12) AS a, right(line, 12) AS b FROM u WHERE length(line) >= 24),
near AS (SELECT x.line FROM e x JOIN e y ON x.a = y.a AND abs(x.n - y.n) <= 1 AND x.line <> y.line WHERE y.f < x.f AND levenshtein(x.line, y.line) <= 1
  UNION SELECT x.line FROM e x JOIN e y ON x.b = y.b AND abs(x.n - y.n) <= 1 AND x.line <> y.line WHERE y.f < x.f AND levenshtein(x.line, y.line) <= 1),
k AS (SELECT o.r, o.pos, o.line FROM o LEFT JOIN u ON o.line = u.line AND u.f = o.f LEFT JOIN near ON o.line = near.line
  WHERE trim(o.line) = '' OR (u.line IS NOT NULL AND near.line IS NULL)),
t AS (SELECT r, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY pos) AS text FROM k GROUP BY r)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, coalesce(n_kept, 0)::BIGINT AS n_kept, sha256(coalesce(t.text, '')) AS text_sha256
FROM d LEFT JOIN t USING (r)
"""
