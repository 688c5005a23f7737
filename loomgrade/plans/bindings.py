"""How the engine's entities are read from the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrade.session import table

NOW = "2024-01-31 00:00:00"


def skills(spark: SparkSession, sf: str) -> DataFrame:
    """skill_id, name, text, lang, scope, tags, vec, label: documents with an embedding; odd ids are global."""
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    scope = F.when(F.col("vec_id") % 2 == 0, "project").otherwise("global")
    return d.join(e, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("skill_id"), F.col("source").alias("name"), "text", "lang", scope.alias("scope"), F.array("lang", "source").alias("tags"), F.col("embedding").alias("vec"), "label")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, prompt, qvec, qlabel: every twentieth skill asks for others like it."""
    return skills(spark, sf).where("skill_id % 20 = 0").select(F.col("skill_id").alias("query_id"), F.col("text").alias("prompt"), F.col("vec").alias("qvec"), F.col("label").alias("qlabel"))


def subunits(spark: SparkSession, sf: str) -> DataFrame:
    """Three sub-sections a skill: the texts and vectors of the next ids, where they exist."""
    s = skills(spark, sf)
    kids = s.select(F.explode(F.array(*[F.col("skill_id") - i for i in (1, 2, 3)])).alias("parent"), F.col("skill_id").alias("subunit_id"), F.col("name").alias("title"), F.col("text").alias("content"), F.col("vec").alias("svec"))
    return s.select("skill_id").join(kids, F.col("skill_id") == F.col("parent")).drop("parent")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("skill_id"), F.col("ts").alias("used_at"), "event_type", "event_id", "value", "props")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """skill_id, position, line: the sub-sections for lexical work."""
    return skills(spark, sf).select("skill_id", "label", "scope", F.posexplode(F.split("text", "\n", -1)).alias("position", "line"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """skills with source_paths, status and description as rebuilt collections have them."""
    status = F.element_at(F.array(*[F.lit(x) for x in ("ready", "draft", "deprecated", "retired")]), (F.col("skill_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/home/team/"), F.col("lang"), F.when(F.col("skill_id") % 3 == 0, F.lit("/.skills/")).otherwise(F.lit("/my-skills/")), F.col("name"), F.lit("/SKILL.md"))
    own = F.when(F.col("skill_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(path))
    return skills(spark, sf).select("*", status.alias("status"), own.alias("source_paths"), F.substring_index("text", "\n", 1).alias("description"))


def words_sql(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SKILLS = """sk AS (SELECT d.doc_id AS skill_id, d.source AS name, d.text, d.lang, CASE WHEN e.vec_id % 2 = 0 THEN 'project' ELSE 'global' END AS scope,
  [d.lang, d.source] AS tags, e.embedding::DOUBLE[] AS vec, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""
QUERIES = f"qu AS (SELECT skill_id AS query_id, text AS prompt, {words_sql('text')} AS pw, vec AS qvec, label AS qlabel FROM sk WHERE skill_id % 20 = 0)"
SUBUNITS = f"""su AS (SELECT p.skill_id, c.skill_id AS subunit_id, c.name AS title, c.text AS content, {words_sql("c.name || ' ' || c.text")} AS cw, c.vec AS svec FROM sk p JOIN sk c ON c.skill_id BETWEEN p.skill_id + 1 AND p.skill_id + 3)"""
PATHS = """pa AS (SELECT *, ['ready', 'draft', 'deprecated', 'retired'][(skill_id % 4 + 1)::INT] AS status,
  CASE WHEN skill_id % 7 = 0 THEN []::VARCHAR[] ELSE ['/home/team/' || lang || CASE WHEN skill_id % 3 = 0 THEN '/.skills/' ELSE '/my-skills/' END || name || '/SKILL.md'] END AS source_paths,
  split_part(text, chr(10), 1) AS description FROM sk)"""


def overlap_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


def cosine_sql(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
