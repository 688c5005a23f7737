"""Queries of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrade.functions import text as X
from loomgrade.functions.fixed import STOP_WORDS
from loomgrade.operators import density as D
from loomgrade.operators import graph as G
from loomgrade.plans import bindings as B
from loomgrade.session import materialise


def _links(spark, sf):
    s = B.skills(spark, sf)
    return s.select("skill_id", F.explode(F.array(F.concat(F.lit("c-"), F.col("label").cast("string")), F.concat(F.lit("t-"), F.col("lang")))).alias("community_id"))


def skills_with_communities(spark, sf):
    rows = G.skills_with_communities(B.skills(spark, sf).select("skill_id", "name"), _links(spark, sf))
    return rows.select("skill_id", "name", F.array_join("communities", ",").alias("communities"))


def communities_with_members(spark, sf):
    links = _links(spark, sf)
    rows = G.communities_with_members(links.select("community_id").distinct(), links)
    return rows.select("community_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def list_communities(spark, sf):
    """Every community by name with its scope, which is the project's if one of its members is, and its number of members."""
    members = _links(spark, sf).join(B.skills(spark, sf).select("skill_id", "scope"), "skill_id")
    found = members.groupBy("community_id").agg(F.when(F.bool_or(F.col("scope") == "project"), "project").otherwise("global").alias("scope"), F.count("*").alias("member_count"))
    return found.select("community_id", F.concat("scope", F.lit("-"), F.substring("community_id", 3, 1 << 30)).alias("name"), "scope", "member_count")


def stable_ids(spark, sf):
    """Ids of skills, and of their sub-sections by position and name: equal for equal skills, whatever run makes them."""
    s = B.skills(spark, sf).select("skill_id", "name", F.posexplode(F.split("text", "\n", -1)).alias("position", "line"))
    key = F.col("skill_id").cast("string")
    part = F.concat_ws(":", key, F.col("position").cast("string"), "name")
    return s.select("skill_id", "position", X.stable_id("skill", key).alias("skill_uuid"), X.stable_id("subunit", part).alias("subunit_uuid"))


def ordered_subunits(spark, sf):
    rows = G.ordered_subunits(B.lines(spark, sf).select("skill_id", "position", F.col("line").alias("content")))
    return rows.select("skill_id", F.size("subunits").cast("bigint").alias("n"), F.md5(F.array_join("subunits", "|")).alias("digest"))


def inspect_neighbourhood(spark, sf):
    s = B.skills(spark, sf)
    rows = G.inspect_neighbourhood(s.select("skill_id", F.array("name").alias("tags")), _links(spark, sf), s.where("skill_id % 20 = 0").select("skill_id"))
    return rows.select("asked_id", "community", "community_members", "skill_id", F.array_join("shared_tags", ",").alias("shared_tags"), "same_community")


def tag_communities(spark, sf):
    return G.tag_communities(B.skills(spark, sf))


def _scores(spark, sf):
    return G.term_scores(B.skills(spark, sf).select(F.col("label").alias("cluster"), "skill_id", "text"))


def tf_df(spark, sf):
    return _scores(spark, sf).select("cluster", "term", "tf", "df", "score")


def tfidf_cluster_label(spark, sf):
    scopes = B.skills(spark, sf).groupBy(F.col("label").alias("cluster")).agg(F.min("skill_id").alias("first_member")).withColumn("scope", F.lit("global"))
    return G.cluster_labels(_scores(spark, sf), scopes)


def density_clusters(spark, sf):
    return D.density_clusters(B.skills(spark, sf))


def graph_communities(spark, sf):
    """Both layers as a rebuild makes them: density clusters of the vectors, named by their terms, and tag groups."""
    found = materialise(D.density_clusters(B.skills(spark, sf)), "clusters")
    return G.communities(found, B.skills(spark, sf))


def dual_membership(spark, sf):
    density = B.skills(spark, sf).select("scope", "skill_id", F.col("label").cast("bigint").alias("cluster"))
    return G.cluster_names(density).unionByName(G.tag_communities(B.skills(spark, sf)))


def recurrence_components(spark, sf):
    return G.recurrence_clusters(B.skills(spark, sf).where("scope = 'project'").select("skill_id", "vec"), 0.35)


def project_root_key(spark, sf):
    return B.paths(spark, sf).select("skill_id", G.project_root_key(F.col("source_paths")).alias("root"))


def distinct_root_gate(spark, sf):
    """Clusters of project skills that span two project roots or more."""
    own = B.paths(spark, sf).where("scope = 'project' AND status IN ('ready', 'draft') AND size(source_paths) > 0")
    rows = own.select("skill_id", F.col("label").alias("cluster"), G.project_root_key(F.col("source_paths")).alias("root"))
    return rows.groupBy("cluster").agg(F.countDistinct("root").alias("roots"), F.min("skill_id").alias("representative")).where("roots >= 2")


def scope_policy(spark, sf):
    """A cluster is the project's if one of its skills is."""
    return B.skills(spark, sf).groupBy(F.col("label").alias("cluster")).agg(F.when(F.bool_or(F.col("scope") == "project"), "project").otherwise("global").alias("scope"))


LINKS = "li AS (SELECT skill_id, 'c-' || label AS community_id FROM sk UNION ALL SELECT skill_id, 't-' || lang FROM sk)"
TERMS = f"""wd AS (SELECT cluster, skill_id, unnest(list_filter(list_transform(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 3), lambda x: {B.LOWER.format('x')}),
  lambda x: NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains([{', '.join(repr(w) for w in STOP_WORDS)}], x))) AS term FROM (SELECT label AS cluster, skill_id, text FROM sk)),
ts AS (SELECT cluster, term, tf, df, round(tf * (ln(((SELECT count(*) FROM sk) + 1)::DOUBLE / (df + 1)) + 1), 6) AS score FROM (SELECT cluster, term, count(*) AS tf FROM wd GROUP BY ALL) JOIN (SELECT term, count(DISTINCT skill_id) AS df FROM wd GROUP BY 1) USING (term))"""
ROOT = r"""CASE WHEN len(source_paths) > 0 THEN CASE WHEN skill_id % 3 = 0 THEN '/home/team/' || lang ELSE '/home/team/' || lang END END"""
UUID = lambda h: f"concat_ws('-', left({h}, 8), substr({h}, 9, 4), '4' || substr({h}, 14, 3), ['8', '9', 'a', 'b'][('0x' || substr({h}, 17, 1))::INT % 4 + 1] || substr({h}, 18, 3), substr({h}, 21, 12))"

QUERIES = {
    "skills_with_communities": (skills_with_communities, f"WITH {B.SKILLS}, {LINKS} SELECT sk.skill_id, name, coalesce(string_agg(DISTINCT community_id, ',' ORDER BY community_id), '') AS communities FROM sk LEFT JOIN li ON sk.skill_id = li.skill_id GROUP BY ALL"),
    "communities_with_members": (communities_with_members, f"WITH {B.SKILLS}, {LINKS} SELECT community_id, coalesce(string_agg(skill_id::VARCHAR, ',' ORDER BY skill_id), '') AS members FROM li GROUP BY 1"),
    "list_communities": (list_communities, f"""WITH {B.SKILLS}, {LINKS} SELECT community_id, scope || '-' || substr(community_id, 3) AS name, scope, member_count FROM (
SELECT community_id, CASE WHEN bool_or(scope = 'project') THEN 'project' ELSE 'global' END AS scope, count(*) AS member_count FROM li JOIN sk USING (skill_id) GROUP BY 1)"""),
    "stable_ids": (stable_ids, f"""WITH {B.SKILLS}, pt AS (SELECT skill_id, name, unnest(range(len(string_split(text, chr(10)))))::INT AS position FROM sk),
hs AS (SELECT *, sha256('skill:' || skill_id) AS h, sha256('subunit:' || skill_id || ':' || position || ':' || name) AS g FROM pt)
SELECT skill_id, position, {UUID('h')} AS skill_uuid, {UUID('g')} AS subunit_uuid FROM hs"""),
    "ordered_subunits": (ordered_subunits, f"WITH {B.SKILLS} SELECT skill_id, len(string_split(text, chr(10)))::BIGINT AS n, md5(array_to_string(string_split(text, chr(10)), '|')) AS digest FROM sk"),
    "inspect_neighbourhood": (inspect_neighbourhood, f"""WITH {B.SKILLS}, {LINKS}, pm AS (SELECT skill_id, min(community_id) AS p FROM li GROUP BY 1), cs AS (SELECT community_id, count(*) AS n FROM li GROUP BY 1)
SELECT a.skill_id AS asked_id, pa.p AS community, cs.n AS community_members, b.skill_id, CASE WHEN a.name = b.name THEN a.name ELSE '' END AS shared_tags, pa.p = pb.p AS same_community
FROM sk a JOIN sk b ON a.skill_id <> b.skill_id AND (a.label = b.label OR a.lang = b.lang OR a.name = b.name) JOIN pm pa ON a.skill_id = pa.skill_id JOIN pm pb ON b.skill_id = pb.skill_id JOIN cs ON cs.community_id = pa.p WHERE a.skill_id % 20 = 0"""),
    "tag_communities": (tag_communities, f"WITH {B.SKILLS} SELECT skill_id, scope || '-' || lang AS name, 'tag' AS source FROM sk"),
    "tf_df": (tf_df, f"WITH {B.SKILLS}, {TERMS} SELECT cluster, term, tf, df, score FROM ts"),
    "tfidf_cluster_label": (tfidf_cluster_label, f"""WITH {B.SKILLS}, {TERMS}, tt AS (SELECT cluster, list(term ORDER BY r) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS r FROM ts) WHERE r <= 3 GROUP BY 1),
l2 AS (SELECT *, 'global-cluster-' || terms[1] || '-' || terms[2] AS l, row_number() OVER (PARTITION BY terms[1], terms[2] ORDER BY cluster) AS t FROM tt),
l3 AS (SELECT cluster, CASE WHEN t = 1 THEN l ELSE l || '-' || terms[3] END AS l FROM l2)
SELECT cluster, CASE WHEN row_number() OVER (PARTITION BY l ORDER BY cluster) = 1 THEN l ELSE l || '-' || (SELECT min(skill_id) FROM sk WHERE label = cluster) END AS label FROM l3"""),
    "density_clusters": (density_clusters, None),
    "graph_communities": (graph_communities, None),
    "dual_membership": (dual_membership, f"WITH {B.SKILLS} SELECT skill_id, scope || '-cluster-' || label AS name, 'hdbscan' AS source FROM sk UNION ALL SELECT skill_id, scope || '-' || lang, 'tag' FROM sk"),
    "recurrence_components": (recurrence_components, f"""WITH RECURSIVE {B.SKILLS}, pj AS (SELECT * FROM sk WHERE scope = 'project'), ed AS (SELECT a.skill_id AS a, b.skill_id AS b FROM pj a JOIN pj b ON a.skill_id <> b.skill_id AND round({B.cosine_sql('a.vec', 'b.vec')}, 6) >= 0.35),
re AS (SELECT skill_id AS a, skill_id AS b FROM pj UNION SELECT re.a, ed.b FROM re JOIN ed ON re.b = ed.a) SELECT a AS skill_id, min(b) AS representative FROM re GROUP BY 1"""),
    "project_root_key": (project_root_key, f"WITH {B.SKILLS}, {B.PATHS} SELECT skill_id, {ROOT} AS root FROM pa"),
    "distinct_root_gate": (distinct_root_gate, f"WITH {B.SKILLS}, {B.PATHS} SELECT label AS cluster, count(DISTINCT {ROOT}) AS roots, min(skill_id) AS representative FROM pa WHERE scope = 'project' AND status IN ('ready', 'draft') AND len(source_paths) > 0 GROUP BY 1 HAVING count(DISTINCT {ROOT}) >= 2"),
    "scope_policy": (scope_policy, f"WITH {B.SKILLS} SELECT label AS cluster, CASE WHEN bool_or(scope = 'project') THEN 'project' ELSE 'global' END AS scope FROM sk GROUP BY 1"),
}
