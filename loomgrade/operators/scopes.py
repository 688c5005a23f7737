"""Scopes of requests: the project that a path lies in, the folders that are global, and which skills a scope holds.

What a file system knows is given as rows: folders with a marker, folders that exist. A path's project is its nearest
marked ancestor, found by an equi-join of its ancestors with the marked folders, so neither side is crossed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrade.operators.retrieval import under
from loomgrade.operators.skew import HOT, lookup


def plain_path(path: Column) -> Column:
    """A path without empty and `.` components, `..` taken with what is before it; of an absolute one nothing is above the root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", up(s)).otherwise(F.concat(s, F.array(x))))
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def ancestors(path: Column) -> Column:
    """A plain path and all folders above it, the longest first; the root of an absolute one last."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    head = F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    some = F.when(F.size(parts) > 0, F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.concat(head, F.array_join(F.slice(parts, F.lit(1), n), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(head == "/", F.concat(some, F.array(F.lit("/")))).otherwise(some)


def nearest_marked(paths: DataFrame, marked: DataFrame, hot: int = HOT) -> DataFrame:
    """path, root: the nearest of the marked folders (root) above each different path or at it; paths without one are left out.

    A folder that very many paths lie in, as the root is, is no task's burden: rows of hot ancestors stay where they are.
    """
    roots = marked.select(plain_path(F.col("root")).alias("ancestor")).where("ancestor <> ''").distinct().withColumn("root", F.col("ancestor"))
    steps = paths.select("path").where("path IS NOT NULL").distinct().select("path", F.explode(ancestors(plain_path(F.col("path")))).alias("ancestor"))
    found = lookup(steps, "ancestor", roots, hot)
    return found.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def resolve_projects(requests: DataFrame, marked: DataFrame, configured: str | None = None, exists: bool = True, start: str | None = None, hot: int = HOT) -> DataFrame:
    """requests (repo_path, any others) with project_root, resolver and degraded.

    A path's nearest marked folder wins; then the configured root, if there is one, which is taken at its word if it `exists` and degrades
    all other requests if it does not; a path that leads nowhere degrades its request; one without a path goes by `start`.
    degraded: configured_root_missing, no_marker_above_path or no_marker_above_start, null for resolved requests.
    """
    spark = requests.sparkSession
    named = (configured or "").strip()
    asked = requests.select(F.col("repo_path").alias("path"))
    if start is not None:
        asked = asked.unionByName(spark.createDataFrame([(start,)], "path string"))
    near = nearest_marked(asked, marked, hot)
    first = near.where(F.col("path") == start).first() if start is not None else None
    rows = lookup(requests.withColumn("__path", F.col("repo_path")), "__path", near.select(F.col("path").alias("__path"), F.col("root").alias("__root")), hot, "left").drop("__path")
    found, given = F.col("__root").isNotNull(), F.col("repo_path").isNotNull()
    at_start = F.lit(first.root if first else None).cast("string")
    root = F.when(found, F.col("__root")).when(F.lit(bool(named)), F.lit(named if exists else None)).when(~given, at_start)
    why = F.when(F.lit(bool(named)), F.lit(None if exists else "configured_root_missing")).when(given, F.lit("no_marker_above_path")).when(at_start.isNull(), F.lit("no_marker_above_start"))
    resolver = F.when(found | (F.lit(not named) & ~given), F.lit("marker")).otherwise(F.lit("configured"))
    return rows.withColumns({"project_root": root, "degraded": F.when(~found, why)}).withColumn("resolver", F.when(F.col("project_root").isNotNull(), resolver)).drop("__root")


def global_scope(paths: Column, allowed: Column) -> Column:
    """paths (plain) and degraded of a global scope's configured folders, all of which must lie in an allowed root.

    degraded: no_paths, no_allowed_roots, allowed_root_not_absolute, path_not_absolute or path_outside_roots, the first that
    holds; null if the scope is good. Paths are null then.
    """
    some = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    own, roots = some(paths), some(allowed)
    absolute = lambda a: F.forall(a, lambda x: F.startswith(x, F.lit("/")))
    plain, plain_roots = F.transform(own, plain_path), F.transform(roots, plain_path)
    inside = F.exists(plain_roots, lambda r: r == "/") | under(plain, plain_roots)
    why = (
        F.when(F.size(own) == 0, "no_paths")
        .when(F.size(roots) == 0, "no_allowed_roots")
        .when(~absolute(roots), "allowed_root_not_absolute")
        .when(~absolute(own), "path_not_absolute")
        .when(~inside, "path_outside_roots")
    )
    return F.struct(F.when(why.isNull(), plain).alias("paths"), why.alias("degraded"))


def in_scope(skill_type: Column, skill_scope_id: Column, source_paths: Column, scope_type: Column, scope_id: Column, scope_paths: Column) -> Column:
    """Whether a skill belongs to a scope: of its type and its id, and all of its source paths under the scope's, if it has any."""
    return (skill_type == scope_type) & (skill_scope_id == scope_id) & under(source_paths, scope_paths)
