"""Files in and out: procedural documents, fingerprints, transcripts, drafts and proposals.

Reading goes through Spark's own sources, so any store that Spark can read will do. Snapshots: see `snapshots`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrade.functions.fixed import IGNORED_DIRECTORIES, LIFECYCLE_FILES, SECTIONS


def lifecycle_name(path: Column) -> Column:
    """The lifecycle file's name in its usual case, whatever case the path has; null for other files."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.lit(None).cast("string")
    for known in LIFECYCLE_FILES:
        out = F.when(name == known.lower(), F.lit(known)).otherwise(out)
    return out


def _kept(path: Column) -> Column:
    return ~F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.array(*[F.lit(d) for d in IGNORED_DIRECTORIES]))


def fingerprints(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, hash, modified of every lifecycle file below the roots, outside ignored folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    rows = files.where(lifecycle_name(F.col("path")).isNotNull() & _kept(F.col("path")))
    return rows.select("path", F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("modified"))


def skill_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, text of active files whose folder holds no retired marker. Spark lists no empty files, so a marker says something."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    rows = files.select("path", "content", lifecycle_name(F.col("path")).alias("kind"), F.regexp_replace("path", "/[^/]*$", "").alias("folder")).where(_kept(F.col("path")))
    retired = rows.where(F.col("kind") == "SKILL.md.retired").select("folder").distinct()
    return rows.where(F.col("kind") == "SKILL.md").join(retired, "folder", "left_anti").select("path", F.col("content").cast("string").alias("text"))


def parse_skills(files: DataFrame) -> DataFrame:
    """path, name, description, tags, subunits (position, kind, title, content) of Markdown with or without front-matter.

    The front-matter of a closed `---` block wins over the body: `# ` titles, a `tags:` line, the first plain line. Bullets
    belong to the last of the known headings above them, summary at first.
    """
    block = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    closed = F.col("text").rlike(r"(?s)\A---\n.*?\n---\n")
    body = F.when(closed, F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "")).otherwise(F.col("text"))
    rows = files.select("path", F.when(closed, block).alias("head"), F.transform(F.split(body, "\n"), lambda x: F.trim(x)).alias("lines"))
    field = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("head", rf"(?m)^{k}:[ \t]*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))
    inline = lambda k: F.split(F.regexp_replace(field(k), r"^\[|\]$", ""), ",")
    listed = lambda k: F.regexp_extract_all(F.regexp_extract("head", rf"(?m)^{k}:[ \t]*\n((?:[ \t]*- .*\n?)+)", 1), F.lit(r"(?m)^[ \t]*- (.*)$"))
    clean = lambda a: F.filter(F.transform(a, lambda t: F.trim(F.regexp_replace(F.trim(t), "^[\"']|[\"']$", ""))), lambda t: t != "")
    some = lambda k: F.when(field(k).isNotNull(), clean(inline(k))).otherwise(clean(listed(k)))
    own_tags = F.when(F.size(some("tags")) > 0, some("tags")).otherwise(some("suggested_tags"))
    titles = F.filter("lines", lambda x: F.startswith(x, F.lit("# ")) & (F.trim(F.substr(x, F.lit(3))) != ""))
    tag_lines = F.flatten(F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit("tags:"))), lambda x: F.split(F.substr(x, F.lit(6)), ",")))
    plain = F.filter("lines", lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("tags:")))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    heads = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    last_kind = lambda i: F.get(F.reverse(F.filter(F.transform(F.slice("lines", 1, i + 1), lambda x: F.try_element_at(heads, F.lower(x))), lambda k: k.isNotNull())), 0)
    bullets = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.startswith(s["x"], F.lit("- ")))
    made = F.transform(bullets, lambda s, p: F.struct(p.alias("position"), F.coalesce(last_kind(s["i"]), F.lit("summary")).alias("kind"), F.concat(F.initcap(F.coalesce(last_kind(s["i"]), F.lit("summary"))), F.lit(" note")).alias("title"), F.trim(F.substr(s["x"], F.lit(3))).alias("content")))
    none = F.array().cast("array<string>")
    return rows.select(
        "path",
        F.coalesce(field("name"), F.trim(F.substr(F.try_element_at(titles, F.lit(-1)), F.lit(3))), stem).alias("name"),
        F.coalesce(field("description"), F.get(plain, 0), F.lit("No description provided")).alias("description"),
        F.coalesce(F.when(F.size(own_tags) > 0, own_tags), clean(tag_lines), none).alias("tags"),
        made.alias("subunits"),
    )


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """session_id (the file's path), line (from 0), json of every line of JSONL files; lines end at a line feed.

    A large file is read in byte ranges by many tasks. A line's number is its place in its range, by the order in which a task
    reads, and how many lines the ranges before have: a prefix sum over a row a range. What follows a last line feed is a line only if it
    is not empty. Files are read twice, as text and for their lines' number.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    at = [F.col("_metadata.file_path").alias("session_id"), F.col("_metadata.file_block_start").alias("block")]
    read = lines.select(*at, F.monotonically_increasing_id().alias("place"), F.col("value").alias("json"))
    ranges = read.groupBy("session_id", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("session_id", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return read.join(ranges, ["session_id", "block"]).select("session_id", (F.col("place") + F.col("shift")).alias("line"), "json")


def strict_transcript(lines: DataFrame) -> DataFrame:
    """session_id, line, speaker, content; fails on a line that is no JSON, naming file and line, and skips lines without speaker or content."""
    v = F.try_parse_json("json")
    where = F.concat(F.lit("no JSON: "), F.col("session_id"), F.lit(", line "), F.col("line").cast("string"))
    v = F.when(v.isNull(), F.raise_error(where).cast("variant")).otherwise(v)
    get = lambda p: F.try_variant_get("v", p, "string")
    rows = lines.where(F.trim("json") != "").select("session_id", "line", v.alias("v"))
    speaker, content = F.coalesce(get("$.speaker"), get("$.role"), get("$.message.role")), F.coalesce(get("$.content"), get("$.message.content"))
    return rows.select("session_id", "line", speaker.alias("speaker"), content.alias("content")).where("trim(speaker) <> '' AND trim(content) <> ''")


def without_entries(lines: DataFrame) -> DataFrame:
    """session_id of transcripts that `strict_transcript` finds no entry in, which a loader has to report."""
    return lines.select("session_id").distinct().join(strict_transcript(lines).select("session_id").distinct(), "session_id", "left_anti")


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """point_id, vec, at: the later of each point's rows, ties to the new one."""
    rows = old.withColumn("__g", F.lit(0)).unionByName(new.withColumn("__g", F.lit(1)))
    cols = [c for c in new.columns if c != "point_id"]
    return rows.groupBy("point_id").agg(F.max_by(F.struct(*cols), F.struct("at", "__g")).alias("r")).select("point_id", "r.*")


def new_proposals(proposals: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """Proposals that are not there yet, one for each key."""
    return proposals.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def audit_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Audit rows with an id made from what they say; rows that are there already are not written again."""
    made = rows.withColumn("id", F.sha2(F.concat_ws("|", "entity_type", "entity_id", "action", F.col("happened_at").cast("string")), 256))
    return new_proposals(made, existing, "id")


def draft_markdown(candidates: DataFrame) -> DataFrame:
    """path, markdown of drafts: front-matter, title, description and sections. candidates: slug, name, description, tags, generality, procedures, conventions."""
    known = F.when(F.col("generality").isin("general", "project"), F.col("generality")).otherwise("uncertain")
    section = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n"))).otherwise("")
    page = F.concat(
        F.lit("---\nname: "), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit("\ngenerality: "), known, F.lit("\ntags: "), F.to_json("tags"), F.lit("\n---\n\n# "),
        F.col("name"), F.lit("\n\n"), F.col("description"), F.lit("\n\n"), section("Procedures", F.col("procedures")), section("Conventions", F.col("conventions")),
    )
    first = F.row_number().over(Window.partitionBy("slug").orderBy("name"))
    return candidates.withColumn("r", first).where("r = 1").select(F.concat("slug", F.lit("/SKILL.md.pending")).alias("path"), page.alias("markdown"))
