"""Queries of maintenance and of ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrade.functions import text as X
from loomgrade.operators import maintenance as M
from loomgrade.operators import metrics as Q
from loomgrade.operators import retrieval as R
from loomgrade.plans import bindings as B
from loomgrade.session import table

TOKENS = ["Eder", "heed", "Thenth", "ouve"]


def cross_scope_duplicates(spark, sf):
    return M.cross_scope_duplicates(B.skills(spark, sf), 0.3, 0.01)


def jaccard_pairs(spark, sf):
    """Pairs of skills that have half of their words in common."""
    return M.jaccard_join(B.skills(spark, sf).select("skill_id", X.blank_words(F.col("text")).alias("w")), 0.5)


def merge_text_digest(spark, sf):
    s = B.skills(spark, sf).select("skill_id", "name", F.substring_index("text", "\n", 1).alias("description"), "tags")
    rows = M.merge_digest(s, B.lines(spark, sf).select("skill_id", "position", F.col("line").alias("content")))
    return rows.select("skill_id", F.md5("digest").alias("digest"))


def usage_summary(spark, sf):
    return M.usage_summary(B.skills(spark, sf), B.usage(spark, sf), B.NOW, 10)


def _samples(spark, sf):
    return B.usage(spark, sf).where("event_type <> 'view'").select("skill_id", "used_at", F.lit(1).alias("n"))


def retirement_scores(spark, sf):
    return M.usage_rates(_samples(spark, sf), B.NOW, 30)


def retirement_proposals(spark, sf):
    return M.retirement_proposals(_samples(spark, sf), B.NOW, 26.0, 30)


def identifier_tokens(spark, sf):
    p = B.paths(spark, sf)
    return M.identifier_tokens(p.select(F.get("source_paths", 0).alias("root")).where("root IS NOT NULL").select(F.expr("concat('/home/team/', split(root, '/')[3], '/x', split(root, '/')[5])").alias("root")))


def identifier_scan(spark, sf):
    return M.identifier_hits(B.skills(spark, sf), TOKENS).where("size(hits) > 0").select("skill_id", F.array_join("hits", ",").alias("hits"))


def intrinsic_promotion(spark, sf):
    return M.intrinsic_promotions(B.paths(spark, sf), TOKENS).select("skill_id")


def demotion_scan(spark, sf):
    return M.demotions(B.paths(spark, sf), TOKENS).select("skill_id", F.array_join("hits", ",").alias("hits"))


def _proposals(spark, sf):
    """Events as proposals: those with an even value say when they were made, some in the future or not as a date."""
    made = F.when(F.col("event_id") % 11 == 0, "no date").when(F.col("event_id") % 7 == 0, "2030-01-01T00:00:00Z").when(F.col("event_id") % 2 == 0, F.date_format(F.col("used_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return B.usage(spark, sf).where("event_type = 'click'").select(F.concat(F.lit("/p/"), F.col("event_id").cast("string")).alias("path"), made.alias("created"), F.col("used_at").alias("mtime"), "event_id")


def pending_warnings(spark, sf):
    rows = _proposals(spark, sf)
    return M.pending_warnings(rows, rows.where("event_id % 5 = 0"), "2024-02-15 00:00:00").select("path", F.unix_timestamp("warning_at").alias("warning_at"))


def reproposal_block(spark, sf):
    return M.tombstones(_proposals(spark, sf), B.NOW, 10).where("blocks").select("path", "age_days")


def tombstone_prune(spark, sf):
    return M.tombstones(_proposals(spark, sf), B.NOW, 10).where("prune").select("path", "age_days")


def _per_query(spark, sf):
    """Ranked ids of each query, where those of the query's own label are relevant."""
    top = R.cosine_topk(B.queries(spark, sf), B.skills(spark, sf), 10).select("query_id", "skill_id", "rank")
    return Q.per_query_by_label(top, B.queries(spark, sf).select("query_id", F.col("qlabel").alias("label")), B.skills(spark, sf).select("skill_id", "label"), k=3)


def ir_metrics_per_query(spark, sf):
    return _per_query(spark, sf)


def ir_metrics_aggregate(spark, sf):
    return Q.aggregate(_per_query(spark, sf))


def no_match_precision(spark, sf):
    top = R.cosine_topk(B.queries(spark, sf), B.skills(spark, sf).where("skill_id % 20 <> 0"), 1).withColumn("returned", (F.col("cosine") >= 0.4).cast("int"))
    return Q.no_match_precision(top.select("query_id", "returned"))


def latency_percentiles(spark, sf):
    return Q.percentiles(table(spark, sf, "events").select("event_type", "value"), "event_type", "value")


PROPS = f"""pp AS (SELECT '/p/' || event_id AS path, event_id, CASE WHEN event_id % 11 = 0 OR (event_id % 7 <> 0 AND event_id % 2 = 1) OR event_id % 7 = 0 THEN ts ELSE date_trunc('second', ts) END AS created_at FROM events WHERE event_type = 'click')"""
AGE = lambda now, c: f"greatest(floor((epoch(TIMESTAMP '{now}') - floor(epoch({c}))) / 86400), 0)"
HITS = "list_sort(list_filter([" + ", ".join(f"'{t}'" for t in sorted(TOKENS)) + "], lambda t: contains(text, t)))"
RATE = f"""ra AS (SELECT user_id AS skill_id, round(sum(CASE WHEN {AGE(B.NOW, 'ts')} <= 30 THEN greatest(1 - {AGE(B.NOW, 'ts')} / 30, 0) ELSE 0 END), 6) AS rate FROM events WHERE event_type <> 'view' GROUP BY 1)"""
RUN = f"""WITH {B.SKILLS}, {B.QUERIES}, ru AS (SELECT query_id, skill_id, rank, label = qlabel AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, skill_id) AS rank FROM (SELECT *, round(greatest({B.cosine_sql('qvec', 'vec')}, 0.0), 6) AS cosine FROM qu, sk)) WHERE rank <= 10),
nr AS (SELECT query_id, count(*) AS n FROM qu JOIN sk ON qlabel = label GROUP BY 1),
pq AS (SELECT query_id, round(count(*) FILTER (hit AND rank <= 3) / 3.0, 6) AS precision_at_k, round(count(*) FILTER (hit AND rank <= 3) / any_value(n)::DOUBLE, 6) AS recall_at_k, round(coalesce(1.0 / min(rank) FILTER (hit), 0.0), 6) AS reciprocal_rank,
  round(coalesce(sum(before / rank::DOUBLE) FILTER (hit), 0.0) / any_value(n), 6) AS average_precision,
  round(coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 3), 0.0) / list_sum(list_transform(range(1, least(3, any_value(n)) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_k, coalesce(bool_or(hit AND rank <= 3), false) AS hit_at_k
  FROM (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY query_id ORDER BY rank) AS before FROM ru) JOIN nr USING (query_id) GROUP BY query_id)"""
S = f"WITH {B.SKILLS}"
P = f"{S}, {B.PATHS}"

QUERIES = {
    "cross_scope_duplicates": (cross_scope_duplicates, f"""{S}, w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(text, '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '')) AS w FROM sk)
SELECT * FROM (SELECT least(a.skill_id, b.skill_id) AS a, greatest(a.skill_id, b.skill_id) AS b, round({B.cosine_sql('a.vec', 'b.vec')}, 6) AS cosine, round(len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM w a JOIN w b ON a.skill_id < b.skill_id AND a.scope <> b.scope) WHERE cosine >= 0.3 AND jaccard >= 0.01"""),
    "jaccard_pairs": (jaccard_pairs, f"""{S}, w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(text, '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '')) AS w FROM sk)
SELECT * FROM (SELECT a.skill_id AS a, b.skill_id AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM w a JOIN w b ON a.skill_id < b.skill_id AND len(a.w) >= 0.5 * len(b.w) AND len(b.w) >= 0.5 * len(a.w)) WHERE jaccard >= 0.5"""),
    "merge_text_digest": (merge_text_digest, f"""{S}, l AS (SELECT skill_id, i, list_filter(regexp_split_to_array(line, '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '')[1:100] AS w FROM (SELECT skill_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM sk)),
m AS (SELECT *, 1500 - coalesce(sum(len(w)) OVER (PARTITION BY skill_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM l WHERE len(w) > 0),
b AS (SELECT skill_id, string_agg(array_to_string(w[1:l::INT], ' '), chr(10) ORDER BY i) AS body FROM m WHERE l > 0 GROUP BY 1)
SELECT skill_id, md5(concat_ws(chr(10), name, split_part(text, chr(10), 1), array_to_string(tags, ', '), body)) AS digest FROM sk LEFT JOIN b USING (skill_id)"""),
    "usage_summary": (usage_summary, f"{S} SELECT skill_id, count(ts) AS uses, count(*) FILTER (ts >= TIMESTAMP '{B.NOW}' - INTERVAL 10 DAY) AS recent, {AGE(B.NOW, 'max(ts)')}::BIGINT AS age_days FROM sk LEFT JOIN events ON user_id = skill_id GROUP BY 1".replace("greatest(floor", "if(max(ts) IS NULL, NULL, greatest(floor").replace("0)::BIGINT", "0))::BIGINT")),
    "retirement_scores": (retirement_scores, f"WITH {RATE} SELECT * FROM ra"),
    "retirement_proposals": (retirement_proposals, f"WITH {RATE} SELECT * FROM ra WHERE rate < 26"),
    "identifier_tokens": (identifier_tokens, f"{P} SELECT DISTINCT token FROM (SELECT unnest([lang, 'team', 'x' || name]) AS token FROM pa WHERE len(source_paths) > 0) WHERE strlen(token) > 2"),
    "identifier_scan": (identifier_scan, f"{S} SELECT skill_id, array_to_string({HITS}, ',') AS hits FROM sk WHERE len({HITS}) > 0"),
    "intrinsic_promotion": (intrinsic_promotion, f"{P} SELECT skill_id FROM pa WHERE scope = 'project' AND status IN ('ready', 'draft') AND len(source_paths) > 0 AND len({HITS}) = 0"),
    "demotion_scan": (demotion_scan, f"{P} SELECT skill_id, array_to_string({HITS}, ',') AS hits FROM pa WHERE scope = 'global' AND status IN ('ready', 'draft') AND len({HITS}) > 0"),
    "pending_warnings": (pending_warnings, f"WITH {PROPS} SELECT path, floor(epoch(created_at + INTERVAL 30 DAY))::BIGINT AS warning_at FROM pp WHERE event_id % 5 <> 0 AND created_at + INTERVAL 30 DAY <= TIMESTAMP '2024-02-15 00:00:00'"),
    "reproposal_block": (reproposal_block, f"WITH {PROPS} SELECT path, {AGE(B.NOW, 'created_at')}::BIGINT AS age_days FROM pp WHERE {AGE(B.NOW, 'created_at')} < 10"),
    "tombstone_prune": (tombstone_prune, f"WITH {PROPS} SELECT path, {AGE(B.NOW, 'created_at')}::BIGINT AS age_days FROM pp WHERE {AGE(B.NOW, 'created_at')} >= 10"),
    "ir_metrics_per_query": (ir_metrics_per_query, f"{RUN} SELECT * FROM pq"),
    "ir_metrics_aggregate": (ir_metrics_aggregate, f"{RUN} SELECT count(*) AS queries, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(reciprocal_rank), 6) AS mrr, round(avg(average_precision), 6) AS map, round(avg(ndcg_at_k), 6) AS ndcg_at_k, round(avg(hit_at_k::INT), 6) AS hit_at_k FROM pq"),
    "no_match_precision": (no_match_precision, f"{S}, {B.QUERIES} SELECT round(1 - avg((m >= 0.4)::INT), 6) AS no_match_precision FROM (SELECT query_id, max(round(greatest({B.cosine_sql('qvec', 'vec')}, 0.0), 6)) AS m FROM qu, sk WHERE skill_id % 20 <> 0 GROUP BY 1)"),
    "latency_percentiles": (latency_percentiles, "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1"),
}
