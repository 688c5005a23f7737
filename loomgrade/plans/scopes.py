"""Queries of scope resolution and of stances."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrade.operators import scopes as S
from loomgrade.operators import stance as A
from loomgrade.session import table

TOKENS = ("thth", "tion", "keit", "absent from all")


def _pages(spark, sf):
    """Pages as files below a folder of their host: page_id, host, place (host and path)."""
    part = lambda n: F.regexp_extract("url", r"^[^:]*://([^/?#]*)([^?#]*)", n)
    return table(spark, sf, "pages").select("page_id", part(1).alias("host"), F.concat(F.lit("/srv/"), part(1), part(2)).alias("place"))


def project_resolution(spark, sf):
    """Nearest marked folder of each page: some hosts are marked, and some languages within them; some requests have no path."""
    p = _pages(spark, sf)
    host = p.where("page_id % 3 = 0").select(F.concat(F.lit("/srv/"), "host").alias("root"))
    lang = p.where("page_id % 5 = 0").select(F.regexp_extract("place", "^/[^/]+/[^/]+/[^/]+", 0).alias("root"))
    asked = p.select("page_id", F.when(F.col("page_id") % 13 > 0, F.concat("place", F.when(F.col("page_id") % 2 == 0, "/./x/..").otherwise(""))).alias("repo_path"))
    return S.resolve_projects(asked, host.unionByName(lang), start="/srv").select("page_id", "project_root", "resolver", "degraded")


def global_scopes(spark, sf):
    """Configured folders of each page against two allowed roots: good ones, relative ones, ones outside, none."""
    p = _pages(spark, sf)
    i = F.col("page_id")
    paths = F.when(i % 7 == 0, F.array(F.lit(" "))).otherwise(F.array(F.when(i % 5 == 0, F.substring("place", 2, 1 << 30)).otherwise(F.concat("place", F.lit("//./y"))), F.lit("/opt/shared/")))
    roots = F.when(i % 11 == 0, F.array(F.lit("opt"))).otherwise(F.array(F.lit("/opt/shared"), F.concat(F.lit("/srv/"), F.when(i % 3 == 0, F.col("host")).otherwise(F.concat("host", F.lit("x"))))))
    made = p.select("page_id", S.global_scope(paths, roots).alias("g"))
    return made.select("page_id", F.array_join("g.paths", ",").alias("paths"), "g.degraded")


def antipattern_stance(spark, sf):
    """How each document stands to each token, some of its words being cautions and endorsements."""
    text = F.col("text")
    for word, cue in ((" by ", " never "), (" is ", " run "), (" des ", " avoid "), (" les ", " use "), (" die ", " instead of ")):
        text = F.replace(text, F.lit(word), F.lit(cue))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    stances = F.explode(F.array(*[F.struct(F.lit(t).alias("token"), A.stance(F.col("text"), t).alias("stance")) for t in TOKENS])).alias("s")
    return docs.select("doc_id", stances).select("doc_id", "s.token", "s.stance")


PAGES = """pg AS (SELECT page_id, regexp_extract(url, '^[^:]*://([^/?#]*)([^?#]*)', 1) AS host, '/srv/' || regexp_extract(url, '^[^:]*://([^/?#]*)([^?#]*)', 1) || regexp_extract(url, '^[^:]*://([^/?#]*)([^?#]*)', 2) AS place FROM pages),
pl AS (SELECT *, rtrim(place, '/') AS plain FROM pg)"""
QUERIES = {
    "project_resolution": (
        project_resolution,
        f"""WITH {PAGES}, mk AS (SELECT '/srv/' || host AS root FROM pg WHERE page_id % 3 = 0 UNION SELECT regexp_extract(place, '^/[^/]+/[^/]+/[^/]+') FROM pg WHERE page_id % 5 = 0),
nr AS (SELECT page_id, arg_max(root, length(root)) AS root FROM pl JOIN mk ON root <> '' AND (plain = root OR starts_with(plain, root || '/')) WHERE page_id % 13 > 0 GROUP BY page_id)
SELECT page_id, root AS project_root, CASE WHEN root IS NOT NULL THEN 'marker' END AS resolver,
  CASE WHEN root IS NULL THEN CASE WHEN page_id % 13 > 0 THEN 'no_marker_above_path' ELSE 'no_marker_above_start' END END AS degraded FROM pg LEFT JOIN nr USING (page_id)""",
    ),
    "global_scopes": (
        global_scopes,
        f"""WITH {PAGES}, wy AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN 'no_paths' WHEN page_id % 11 = 0 THEN 'allowed_root_not_absolute' WHEN page_id % 5 = 0 THEN 'path_not_absolute' WHEN page_id % 3 > 0 THEN 'path_outside_roots' END AS degraded FROM pl)
SELECT page_id, CASE WHEN degraded IS NULL THEN plain || '/y,/opt/shared' END AS paths, degraded FROM wy""",
    ),
    "antipattern_stance": (
        antipattern_stance,
        f"""WITH tx AS (SELECT doc_id, lower(replace(replace(replace(replace(replace(coalesce(text, ''), ' by ', ' never '), ' is ', ' run '), ' des ', ' avoid '), ' les ', ' use '), ' die ', ' instead of ')) AS t FROM documents),
mk AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[\\x{{80}}-\\x{{7FF}}]', '??', 'g'), '[\\x{{800}}-\\x{{FFFF}}]', '???', 'g'), '[\\x{{10000}}-\\x{{10FFFF}}]', '????', 'g') AS m FROM tx),
tk AS (SELECT unnest([{', '.join(repr(t) for t in TOKENS)}]) AS token),
pc AS (SELECT doc_id, token, m, unnest(string_split(m, token)) AS piece, generate_subscripts(string_split(m, token), 1) AS i, len(string_split(m, token)) AS n FROM mk, tk),
ht AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, token ORDER BY i) + (i - 1) * length(token) AS pos FROM pc),
wd AS (SELECT doc_id, token, substr(m, greatest(pos - 120, 0)::BIGINT + 1, (pos - greatest(pos - 120, 0))::BIGINT + length(token) + 120) AS w FROM ht WHERE i < n),
jd AS (SELECT doc_id, token, max(CASE WHEN regexp_matches(w, '{'|'.join(A.CAUTION_CUES).replace("'", "''")}') THEN 2 WHEN regexp_matches(w, '{'|'.join(A.ENDORSEMENT_CUES)}') THEN 3 ELSE 1 END) AS worst FROM wd GROUP BY ALL)
SELECT doc_id, token, ['absent', 'neutral_mention', 'warns_against', 'recommends'][coalesce(worst, 0) + 1] AS stance FROM documents CROSS JOIN tk LEFT JOIN jd USING (doc_id, token)""",
    ),
}
