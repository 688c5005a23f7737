"""Queries of queues, outboxes, snapshots and session state."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrade.operators import state as S
from loomgrade.session import table

NOW = "2024-01-20 00:00:00"


def ingest_dedup(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 50 == 0, " ").otherwise(F.col("source")).alias("session_id"), F.when(F.col("doc_id") % 49 == 1, "").otherwise(F.col("text")).alias("content"))
    return S.ingest(d).select("id", "content_hash", "outcome")


def idempotency_ttl(spark, sf):
    e = table(spark, sf, "events")
    return S.idempotent(e.select(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("key"), "ts", "event_id"), "key", "ts", "event_id")


def _queue(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "processing").otherwise("published")
    return e.select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("available_at"), (F.col("user_id") % 4).cast("int").alias("attempts"))


def queue_claim(spark, sf):
    return S.claim(_queue(spark, sf), NOW).select("id", "status")


def queue_fail_transition(spark, sf):
    return S.fail_transition(_queue(spark, sf), NOW, 3, 60).select("id", "status", "attempts", F.unix_timestamp("available_at").alias("available_at"))


def _published(spark, sf):
    return table(spark, sf, "events").where("event_type IN ('click', 'view')").select(F.col("user_id").alias("point_id"), "event_id", F.col("ts").alias("occurred_at"), "event_type")


def outbox_latest_by_point(spark, sf):
    return S.latest_by_point(_published(spark, sf)).select("point_id", "event_id", "event_type")


def _present(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("point_id"))


def reconcile_missing(spark, sf):
    return S.reconcile(_published(spark, sf), _present(spark, sf))[0].select("point_id", "event_id", "idempotency_key")


def reconcile_orphans(spark, sf):
    return S.reconcile(_published(spark, sf), _present(spark, sf))[1]


def outbox_latest_published(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id")


def _snapshots(spark, sf):
    d = table(spark, sf, "documents")
    path = lambda i: F.concat(F.lit("/s/"), F.col("source"), F.lit("/"), i.cast("string"), F.lit(".md"))
    i = F.col("doc_id")
    old = d.where("doc_id % 10 <> 3").select(path(i).alias("path"), F.md5(F.concat("text", i.cast("string"))).alias("hash"))
    moved = F.when(i % 10 == 4, i + 1_000_000).otherwise(i)
    text = F.when(i % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("doc_id % 10 <> 6").select(path(moved).alias("path"), F.md5(F.concat(text, i.cast("string"))).alias("hash"))
    return old, new


def snapshot_diff(spark, sf):
    return S.snapshot_diff(*_snapshots(spark, sf))


def rename_detection(spark, sf):
    return S.snapshot_diff(*_snapshots(spark, sf)).where("change = 'renamed'").select("path", "old_path")


def _calls(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("call_id"), F.col("user_id").alias("session_id"), "event_type", F.floor(F.dayofmonth("ts") / 10).cast("bigint").alias("version"), F.col("ts").alias("at"), (F.col("value") < 60).alias("ok"))


def session_suppression(spark, sf):
    return S.session_suppression(_calls(spark, sf).withColumnRenamed("event_type", "repo")).select("call_id", "suppressed")


def cache_hits(spark, sf):
    return S.cache_hits(_calls(spark, sf).withColumn("key", (F.col("session_id") % 7).cast("string")), 1800).select("call_id", "hit")


def circuit_breaker(spark, sf):
    return S.circuit_breaker(_calls(spark, sf).withColumnRenamed("event_type", "provider"), 3, 3600.0)


def coalesced_refresh(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 50 == 7, "graph.rebuilt").otherwise("other")
    return S.coalesced_refresh(e.select(F.col("event_id").alias("seq"), kind.alias("event_type"), F.floor(F.col("event_id") / 100).cast("bigint").alias("version")))


def session_usage(spark, sf):
    """Usage rows of four parallel arrays a session, exploded together."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("e"))
    arrays = e.select("user_id", F.transform("e", lambda x: x["event_id"]).alias("ids"), F.transform("e", lambda x: x["value"]).alias("scores"))
    return arrays.select("user_id", F.explode(F.arrays_zip("ids", "scores")).alias("z")).select(F.col("user_id").alias("session_id"), F.col("z.ids").alias("skill_id"), F.col("z.scores").alias("relevance"))


SNAP = """o AS (SELECT '/s/' || source || '/' || doc_id || '.md' AS path, md5(text || doc_id) AS h, '/s/' || source AS f FROM documents WHERE doc_id % 10 <> 3),
n AS (SELECT '/s/' || source || '/' || CASE WHEN doc_id % 10 = 4 THEN doc_id + 1000000 ELSE doc_id END || '.md' AS path, md5(CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END || doc_id) AS h, '/s/' || source AS f FROM documents WHERE doc_id % 10 <> 6),
g AS (SELECT *, row_number() OVER (PARTITION BY h, f ORDER BY path) AS r FROM o WHERE path NOT IN (SELECT path FROM n)), a AS (SELECT *, row_number() OVER (PARTITION BY h, f ORDER BY path) AS r FROM n WHERE path NOT IN (SELECT path FROM o)),
df AS (SELECT coalesce(a.path, g.path) AS path, CASE WHEN a.path IS NOT NULL THEN g.path END AS old_path, CASE WHEN a.path IS NULL THEN 'removed' WHEN g.path IS NULL THEN 'added' ELSE 'renamed' END AS change FROM a FULL JOIN g ON a.h = g.h AND a.f = g.f AND a.r = g.r
  UNION ALL SELECT o.path, NULL, 'modified' FROM o JOIN n USING (path) WHERE o.h <> n.h)"""
PUB = "pu AS (SELECT user_id AS point_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)"
CHAIN = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS r FROM ({rows})),
w AS (SELECT key, r, event_id, epoch_us(ts) AS t, v, false AS hit FROM e WHERE r = 1 UNION ALL
  SELECT e.key, e.r, e.event_id, CASE WHEN {hit} THEN w.t ELSE epoch_us(e.ts) END, CASE WHEN {hit} THEN w.v ELSE e.v END, {hit} FROM w JOIN e ON e.key = w.key AND e.r = w.r + 1)"""

QUERIES = {
    "ingest_dedup": (ingest_dedup, """WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN ' ' ELSE source END AS s, CASE WHEN doc_id % 49 = 1 THEN '' ELSE text END AS c FROM documents)
SELECT id, sha256(c) AS content_hash, CASE WHEN trim(s) = '' THEN 'blank_session_id' WHEN trim(c) = '' THEN 'blank_content' WHEN id = min(id) FILTER (trim(s) <> '' AND trim(c) <> '') OVER (PARTITION BY c) THEN 'enqueued' ELSE 'duplicate' END AS outcome FROM d"""),
    "idempotency_ttl": (idempotency_ttl, CHAIN.format(rows="SELECT event_type || '-' || user_id AS key, ts, event_id, 0 AS v FROM events", hit="epoch_us(e.ts) - w.t < 86400000000") + " SELECT key, event_id FROM w WHERE NOT hit"),
    "queue_claim": (queue_claim, f"SELECT event_id AS id, 'processing' AS status FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '{NOW}' ORDER BY ts, event_id LIMIT 16"),
    "queue_fail_transition": (queue_fail_transition, f"SELECT event_id AS id, CASE WHEN user_id % 4 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, (user_id % 4 + 1)::INT AS attempts, floor(epoch(CASE WHEN user_id % 4 + 1 >= 3 THEN ts ELSE TIMESTAMP '{NOW}' + INTERVAL 60 SECOND END))::BIGINT AS available_at FROM events WHERE event_type = 'click'"),
    "outbox_latest_by_point": (outbox_latest_by_point, f"WITH {PUB} SELECT * FROM pu"),
    "outbox_latest_published": (outbox_latest_published, "SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 20"),
    "reconcile_missing": (reconcile_missing, f"WITH {PUB} SELECT point_id, event_id, 'reconcile:' || event_id || ':' || point_id AS idempotency_key FROM pu WHERE point_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0)"),
    "reconcile_orphans": (reconcile_orphans, f"WITH {PUB} SELECT vec_id AS point_id FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id NOT IN (SELECT point_id FROM pu)"),
    "snapshot_diff": (snapshot_diff, f"WITH {SNAP} SELECT * FROM df"),
    "rename_detection": (rename_detection, f"WITH {SNAP} SELECT path, old_path FROM df WHERE change = 'renamed'"),
    "session_suppression": (session_suppression, "SELECT event_id AS call_id, coalesce(lag(day(ts) // 10) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = day(ts) // 10, false) AS suppressed FROM events"),
    "cache_hits": (cache_hits, CHAIN.format(rows="SELECT user_id % 7 AS key, ts, event_id, day(ts) // 10 AS v FROM events", hit="(w.v = e.v AND epoch_us(e.ts) - w.t < 1800000000)") + " SELECT event_id AS call_id, hit FROM w"),
    "circuit_breaker": (circuit_breaker, None),
    "coalesced_refresh": (coalesced_refresh, "SELECT batch, events, reloads, max(v) OVER (ORDER BY batch) AS served FROM (SELECT event_id // 64 AS batch, count(*) AS events, max((event_id % 50 = 7)::INT) AS reloads, max(event_id // 100) FILTER (event_id % 50 = 7) AS v FROM events GROUP BY 1)"),
    "session_usage": (session_usage, "SELECT user_id AS session_id, event_id AS skill_id, value AS relevance FROM events"),
}
