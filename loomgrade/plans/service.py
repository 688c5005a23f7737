"""Queries of the service around ranking, over the star schema's events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrade.functions.fixed import REFUSED_PREFIXES
from loomgrade.operators import service as V
from loomgrade.session import table


def _events(spark, sf):
    return table(spark, sf, "events")


def status_resolution(spark, sf):
    """Calls of sessions: some compact, some degraded, some without results; an extraction clears its session."""
    e, i = _events(spark, sf), F.col("event_id")
    calls = e.select(
        F.col("user_id").alias("session_id"),
        i.alias("call_id"),
        F.col("ts").alias("at"),
        F.concat(F.lit("r"), (i % 2).cast("string")).alias("repo"),
        F.concat(F.lit("p"), (i % 3).cast("string")).alias("prompt"),
        F.array(F.lit("project"), F.lit("global")).alias("scopes"),
        F.floor(F.dayofmonth("ts") / 10).cast("bigint").alias("version"),
        F.when(i % 5 == 0, "compact").alias("trigger"),
        F.when(i % 4 == 0, 0).otherwise(3).alias("found"),
        (i % 7 == 0).alias("degraded"),
        F.array(F.lit("project_timeout"), F.lit("global_timeout")).alias("reasons"),
        (F.col("event_type") == "purchase").alias("clear"),
    )
    return V.resolve_status(calls).select("call_id", "status", "reason", "source")


def _outbox(spark, sf):
    i = F.col("event_id")
    key = F.when(i % 23 == 0, " ").otherwise(F.concat(F.lit("k"), (i % 301).cast("string")))
    return _events(spark, sf).select(i.alias("seq"), F.when(i % 29 == 0, "").otherwise(F.col("event_type")).alias("event_type"), key.alias("idempotency_key"))


def _stored(spark, sf):
    return table(spark, sf, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("idempotency_key"))


def outbox_append(spark, sf):
    return V.append_outbox(_stored(spark, sf), _outbox(spark, sf)).select("seq", "outcome")


def outbox_append_strict(spark, sf):
    return V.append_outbox(_stored(spark, sf), _outbox(spark, sf), strict=True).select("seq", "outcome")


def outbox_publish(spark, sf):
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "processing").otherwise("published")
    return V.transition(_events(spark, sf).select("event_id", status.alias("status")), "publish")


def correlation_exists(spark, sf):
    asked = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("correlation_id"))
    return V.correlated(asked, _events(spark, sf).where("event_type = 'signup'").select(F.col("user_id").alias("correlation_id")))


def version_replay(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("version"), "event_type")
    return V.version_replay(e, e.where("event_type = 'purchase' AND version % 2 = 0"))


def change_recovery(spark, sf):
    i = F.col("event_id")
    rows = _events(spark, sf).select(F.floor(i / 10).cast("bigint").alias("generation"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), i.alias("path"))
    return V.change_recovery(rows)


def lease_lock(spark, sf):
    i = F.col("event_id")
    action = F.when(F.col("event_type") == "click", "renew").when(F.col("event_type") == "signup", "release").otherwise("acquire")
    rows = _events(spark, sf).select((F.col("user_id") % 17).cast("string").alias("name"), i.alias("request_id"), (i % 3).cast("string").alias("owner"), F.col("ts").alias("at"), action.alias("action"), F.lit(1800).alias("seconds"))
    return V.leases(rows).select("request_id", "granted")


def _jobs(spark, sf):
    e, i = _events(spark, sf), F.col("event_id")
    return e.select((F.col("user_id") % 19).alias("queue"), i.alias("job_id"), F.unix_timestamp("ts").alias("requested"), (i % 900).alias("seconds"), (F.col("event_type") != "error").alias("ok"))


def rebuild_jobs(spark, sf):
    return V.job_queue(_jobs(spark, sf), 1_705_708_800)


def job_lifecycle(spark, sf):
    return V.lifecycle(_jobs(spark, sf), 600)


def cron_tick(spark, sf):
    rows = _events(spark, sf).select((F.col("user_id") % 11).cast("string").alias("job"), F.col("event_id").alias("tick_id"), F.unix_timestamp("ts").alias("t"))
    return V.cron_ticks(rows, 3600).select("tick_id", "outcome")


def drain_report(spark, sf):
    status = F.when(F.col("event_type") == "view", "processed").when(F.col("event_type") == "click", "failed").otherwise("skipped")
    return V.report(_events(spark, sf).select((F.col("user_id") % 10).alias("worker"), status.alias("status")), ["worker"], "status", ("processed", "failed", "skipped"))


def transcript_limits(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return V.transcript_limits(c, 6, 400, 1200)


def sanitized_lines(spark, sf):
    from loomgrade.operators.transcripts import sanitize

    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.col("text").alias("content"))
    return V.sanitized_lines(sanitize(c), ["conv_id"], "turn").select("conv_id", F.md5("text").alias("digest"))


def ordered_distinct(spark, sf):
    rows = V.ordered_distinct(_events(spark, sf), ["user_id"], "event_type", "event_id")
    return rows.select("user_id", F.array_join("values", ",").alias("kinds"))


STATUS = """WITH RECURSIVE c AS (SELECT user_id AS s, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, 'r' || event_id % 2 AS repo, 'p' || event_id % 3 AS p, day(ts) // 10 AS v,
  event_id % 5 = 0 AS compact, event_id % 4 <> 0 AS found, event_id % 7 = 0 AS degraded, event_type = 'purchase' AS clear FROM events),
w AS (SELECT s, 0::BIGINT AS r, 0::BIGINT AS i, []::VARCHAR[] AS sup, []::VARCHAR[] AS hits, NULL::VARCHAR AS status, NULL::VARCHAR AS source FROM c GROUP BY s UNION ALL
  SELECT s, r, i, CASE WHEN clear THEN [] WHEN source = 'retrieval' AND status <> 'degraded' THEN list_append(list_filter(sup, lambda x: split_part(x, '|', 1) <> repo), repo || '|' || v) ELSE sup END,
    CASE WHEN clear THEN [] WHEN source = 'retrieval' AND status <> 'degraded' THEN list_append(list_filter(hits, lambda x: split_part(x, '|', 1) <> p), p || '|' || v || '|' || status) ELSE hits END, status, source FROM (
    SELECT *, CASE WHEN clear THEN NULL WHEN source = 'suppression' THEN 'duplicate_suppressed' WHEN source = 'cache' THEN CASE WHEN list_contains(hits, p || '|' || v || '|ok') THEN 'ok' ELSE 'no_match' END WHEN degraded THEN 'degraded' WHEN found THEN 'ok' ELSE 'no_match' END AS status FROM (
      SELECT w.sup, w.hits, c.*, CASE WHEN clear THEN NULL WHEN NOT compact AND list_contains(w.sup, repo || '|' || v) THEN 'suppression'
        WHEN NOT compact AND (list_contains(w.hits, p || '|' || v || '|ok') OR list_contains(w.hits, p || '|' || v || '|no_match')) THEN 'cache' ELSE 'retrieval' END AS source FROM w JOIN c ON c.s = w.s AND c.r = w.r + 1)))
SELECT i AS call_id, status, CASE status WHEN 'duplicate_suppressed' THEN 'already_compiled_for_session' WHEN 'degraded' THEN 'project_timeout' WHEN 'no_match' THEN 'no_relevant_skills' END AS reason, source FROM w WHERE status IS NOT NULL"""
APPEND = """WITH o AS (SELECT event_id AS seq, CASE WHEN event_id % 29 = 0 THEN '' ELSE event_type END AS t, CASE WHEN event_id % 23 = 0 THEN ' ' ELSE 'k' || event_id % 301 END AS k FROM events)
SELECT seq, CASE WHEN t = '' THEN 'blank_event_type' WHEN k = ' ' THEN 'blank_idempotency_key' WHEN k NOT IN (SELECT 'k' || n_nationkey FROM nation) AND seq = min(seq) FILTER (t <> '' AND k <> ' ') OVER (PARTITION BY k) THEN 'appended' ELSE '{again}' END AS outcome FROM o"""
LEASE = """WITH RECURSIVE q AS (SELECT user_id % 17 AS n, event_id AS i, event_id % 3 AS o, epoch_us(ts) AS t, CASE event_type WHEN 'click' THEN 'renew' WHEN 'signup' THEN 'release' ELSE 'acquire' END AS a, row_number() OVER (PARTITION BY user_id % 17 ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT n, 0::BIGINT AS r, 0::BIGINT AS i, NULL::BIGINT AS owner, NULL::BIGINT AS until, false AS granted FROM q GROUP BY n UNION ALL
  SELECT n, r, i, CASE WHEN NOT g THEN owner WHEN a <> 'release' THEN o END, CASE WHEN NOT g THEN until WHEN a <> 'release' THEN t + 1800000000 END, g FROM (
    SELECT q.*, w.owner, w.until, coalesce(w.owner = q.o AND q.t < w.until, false) OR (a = 'acquire' AND (w.owner IS NULL OR q.t >= w.until)) AS g FROM w JOIN q ON q.n = w.n AND q.r = w.r + 1))
SELECT i AS request_id, granted FROM w WHERE r > 0"""
LINES = f"""WITH c AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '[^\\x21-\\x7E \\n]', '', 'g') AS t FROM conversations)
SELECT conv_id, md5(string_agg(role || ': ' || t, chr(10) ORDER BY turn)) AS digest FROM c
WHERE role NOT LIKE '%system%' AND role NOT LIKE '%System%' AND role NOT LIKE '%SYSTEM%' AND trim(t) <> '' AND NOT ({' OR '.join(f"starts_with(t, '{p}')" for p in REFUSED_PREFIXES)}) GROUP BY conv_id"""
CRON = """WITH RECURSIVE q AS (SELECT user_id % 11 AS j, event_id AS i, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id % 11 ORDER BY event_id) AS r FROM events),
w AS (SELECT j, 0::BIGINT AS r, 0::BIGINT AS i, NULL::BIGINT AS last, NULL::VARCHAR AS outcome FROM q GROUP BY j UNION ALL
  SELECT j, r, i, CASE WHEN x = 'run' THEN t ELSE last END, x FROM (
    SELECT q.*, w.last, CASE WHEN q.t < w.last THEN 'error' WHEN w.last IS NULL OR q.t - w.last >= 3600 THEN 'run' ELSE 'wait' END AS x FROM w JOIN q ON q.j = w.j AND q.r = w.r + 1))
SELECT i AS tick_id, outcome FROM w WHERE r > 0"""
JOBS = """WITH RECURSIVE q AS (SELECT user_id % 19 AS queue, event_id AS job_id, floor(epoch(ts))::BIGINT AS requested, event_id % 900 AS seconds, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 19 ORDER BY floor(epoch(ts)), event_id) AS position FROM events),
w AS (SELECT q.*, requested + seconds AS finished FROM q WHERE position = 1 UNION ALL SELECT q.*, greatest(q.requested, w.finished) + q.seconds FROM w JOIN q ON q.queue = w.queue AND q.position = w.position + 1)
SELECT queue, job_id, position, finished - seconds AS started, finished, CASE WHEN requested > 1705708800 THEN NULL WHEN finished - seconds > 1705708800 THEN 'queued' WHEN finished > 1705708800 THEN 'running' WHEN ok THEN 'succeeded' ELSE 'failed' END AS status FROM w"""
LIMITS = """WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER w - 1 AS i, sum(length(coalesce(text, ''))) OVER w AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN n > 400 THEN 'transcript entry ' || i || ' exceeds maximum content size 400' WHEN total > 1200 THEN 'transcript total content size exceeds maximum 1200' END AS x FROM c)
SELECT conv_id AS session_id, CASE WHEN count(*) > 6 THEN 'transcript entry count ' || count(*) || ' exceeds maximum 6' ELSE arg_min(x, i) FILTER (x IS NOT NULL) END AS violation FROM v GROUP BY conv_id"""

QUERIES = {
    "status_resolution": (status_resolution, STATUS),
    "outbox_append": (outbox_append, APPEND.format(again="duplicate")),
    "outbox_append_strict": (outbox_append_strict, APPEND.format(again="conflict")),
    "outbox_publish": (outbox_publish, "SELECT event_id, CASE WHEN event_type = 'click' THEN 'published' WHEN event_type = 'view' THEN 'pending' ELSE 'published' END AS status, CASE WHEN event_type <> 'click' THEN 'cannot publish: status is ' || CASE WHEN event_type = 'view' THEN 'pending' ELSE 'published' END END AS error FROM events"),
    "correlation_exists": (correlation_exists, 'SELECT c_custkey::BIGINT AS correlation_id, c_custkey IN (SELECT user_id FROM events WHERE event_type = \'signup\') AS "exists" FROM customer'),
    "version_replay": (version_replay, "SELECT max(event_id) AS version FROM events HAVING max(event_id) > coalesce(max(event_id) FILTER (event_type = 'purchase' AND event_id % 2 = 0), 0)"),
    "change_recovery": (change_recovery, "SELECT generation, key, path FROM (SELECT event_id // 10 AS generation, 'k' || user_id AS key, event_id AS path, lag(event_id // 10) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR generation - b > 64"),
    "lease_lock": (lease_lock, LEASE),
    "rebuild_jobs": (rebuild_jobs, JOBS),
    "job_lifecycle": (job_lifecycle, """WITH j AS (SELECT event_id AS job_id, floor(epoch(ts))::BIGINT AS requested, event_id % 900 AS seconds, event_type <> 'error' AS ok FROM events)
SELECT job_id, 0 AS seq, 'requested' AS event, requested AS at FROM j UNION ALL SELECT job_id, 1, CASE WHEN seconds > 600 THEN 'timed_out' WHEN ok THEN 'completed' ELSE 'failed' END, requested + least(seconds, 600) FROM j"""),
    "cron_tick": (cron_tick, CRON),
    "drain_report": (drain_report, "SELECT user_id % 10 AS worker, count(*) AS total, count(*) FILTER (event_type = 'view') AS processed, count(*) FILTER (event_type = 'click') AS failed, count(*) FILTER (event_type NOT IN ('view', 'click')) AS skipped FROM events GROUP BY 1"),
    "transcript_limits": (transcript_limits, LIMITS),
    "sanitized_lines": (sanitized_lines, LINES),
    "ordered_distinct": (ordered_distinct, "SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY 1"),
}
