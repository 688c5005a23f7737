"""Queues, outboxes, snapshots and per-session state as batch operators over event logs.

Each has the result that the event-at-a-time machine would have after the whole log; `streaming` runs the same rules
incrementally. Time is a column or a literal, never the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrade.operators.chains import fresh
from loomgrade.operators.walks import walk

MOST_BYTES = 10 * 1024 * 1024
BLOCK = 1024  # batches of events that are scanned together


def ingest(requests: DataFrame) -> DataFrame:
    """requests (id, session_id, content) with outcome: enqueued for the first of a content, duplicate, or why it is refused."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = F.when(blank("session_id"), "blank_session_id").when(blank("content"), "blank_content").when(F.octet_length("content") > MOST_BYTES, "too_large")
    rows = requests.withColumn("reason", reason).withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    first = rows.where("reason IS NULL").groupBy("content_hash").agg(F.min("id").alias("first"))
    rows = rows.join(first, "content_hash", "left")
    return rows.withColumn("outcome", F.coalesce("reason", F.when(F.col("id") == F.col("first"), "enqueued").otherwise("duplicate"))).drop("reason", "first")


def idempotent(events: DataFrame, key: str, time: str, order: str, ttl_seconds: int = 86_400) -> DataFrame:
    """Events that are processed: a key counts as done for `ttl_seconds` from each time it was processed."""
    rows = events.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("__t"), order)
    return fresh(rows, key, "__t", order, None, ttl_seconds * 1_000_000).where("fresh").select(key, order)


def claim(queue: DataFrame, now: str, limit: int = 16) -> DataFrame:
    """The oldest pending rows that are due: status pending, available_at not after now; ties by id."""
    due = queue.where((F.col("status") == "pending") & (F.col("available_at") <= F.lit(now).cast("timestamp")))
    return due.orderBy("available_at", "id").limit(limit).withColumn("status", F.lit("processing"))


def fail_transition(rows: DataFrame, now: str, most_attempts: int = 3, delay_seconds: int = 0) -> DataFrame:
    """Processing rows after a failure: one attempt more, failed at the limit, else pending again after a delay."""
    n = F.col("attempts") + 1
    later = F.lit(now).cast("timestamp") + F.make_dt_interval(secs=F.lit(float(delay_seconds)).cast("decimal(18,6)"))
    over = n >= most_attempts
    return rows.where("status = 'processing'").withColumns({"attempts": n, "status": F.when(over, "failed").otherwise("pending"), "available_at": F.when(over, F.col("available_at")).otherwise(later)})


def latest_by_point(events: DataFrame) -> DataFrame:
    """The last event of each point_id by time, ties by event_id."""
    cols = [c for c in events.columns if c != "point_id"]
    return events.groupBy("point_id").agg(F.max_by(F.struct(*cols), F.struct("occurred_at", "event_id")).alias("e")).select("point_id", "e.*")


def reconcile(published: DataFrame, present: DataFrame, complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """Points to enqueue again (published, not present), and orphans (present, not published), empty if a listing is not complete."""
    latest = latest_by_point(published)
    missing = latest.join(present.select("point_id"), "point_id", "left_anti")
    missing = missing.withColumn("idempotency_key", F.concat(F.lit("reconcile:"), F.col("event_id").cast("string"), F.lit(":"), F.col("point_id").cast("string")))
    orphans = present.select("point_id").distinct().join(latest.select("point_id"), "point_id", "left_anti")
    return missing, orphans if complete else orphans.limit(0)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old_path, change (added, removed, modified, renamed) between two snapshots of path and hash.

    A removed and an added file of one hash in one folder are a rename; of several, they pair in order of path.
    """
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    both = o.join(n, "path", "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    place = lambda h: F.row_number().over(Window.partitionBy(h, "folder").orderBy("path"))
    gone = both.where("new_hash IS NULL").withColumn("folder", folder).select(F.col("path").alias("old_path"), F.col("old_hash").alias("h"), "folder", place("old_hash").alias("nr"))
    come = both.where("old_hash IS NULL").withColumn("folder", folder).select("path", F.col("new_hash").alias("h"), "folder", place("new_hash").alias("nr"))
    pairs = come.join(gone, ["h", "folder", "nr"], "full_outer")
    change = F.when(F.col("path").isNull(), "removed").when(F.col("old_path").isNull(), "added").otherwise("renamed")
    changed = both.where("old_hash IS NOT NULL AND new_hash IS NOT NULL").select("path", F.lit(None).cast("string").alias("old_path"), F.lit("modified").alias("change"))
    moved = pairs.select(F.coalesce("path", "old_path").alias("path"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path"), change.alias("change"))
    return moved.unionByName(changed)


def session_suppression(calls: DataFrame) -> DataFrame:
    """calls (call_id, session_id, repo, version, at) with suppressed: whether the session's last answer was of this version.

    Only answers that were given are remembered, and a suppressed call's version is the remembered one, so the call before decides.
    """
    before = F.lag("version").over(Window.partitionBy("session_id", "repo").orderBy("at", "call_id"))
    return calls.withColumn("suppressed", F.coalesce(before == F.col("version"), F.lit(False)))


def cache_hits(calls: DataFrame, ttl_seconds: int = 600) -> DataFrame:
    """calls (call_id, key, version, at) with hit: an answer of this key and version was stored no longer ago than the TTL.

    An answer is stored by a miss and not renewed by a hit.
    """
    rows = calls.select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("t"), "call_id", "version")
    return fresh(rows, "key", "t", "call_id", "version", ttl_seconds * 1_000_000).select("key", "call_id", (~F.col("fresh")).alias("hit"))


def circuit_breaker(calls: DataFrame, threshold: int = 5, open_seconds: float = 30.0) -> DataFrame:
    """provider, call_id, state before the call (closed, open, half_open) and whether it was let through.

    calls: provider, call_id, at, ok. So many failures in a row open the breaker; after the pause one call tries: success
    closes it, failure opens it again. A provider's calls are walked in order.
    """

    def rule():
        failures, opened = 0, None

        def step(at, ok, **_):
            nonlocal failures, opened
            state = "closed" if opened is None else "half_open" if (at - opened).total_seconds() >= open_seconds else "open"
            if state != "open":
                if ok:
                    failures, opened = 0, None
                else:
                    failures += 1
                    if state == "half_open" or failures >= threshold:
                        opened = at
            return state, state != "open"

        return step

    rows = calls.select("provider", "call_id", "at", "ok")
    return walk(rows, "provider", ["at", "call_id"], rule, "state string, allowed boolean").select("provider", "call_id", "state", "allowed")


def coalesced_refresh(events: DataFrame, batch: int = 64) -> DataFrame:
    """batch, events, reloads (1 if one of them says that the graph was rebuilt) and the version that is served after it.

    events: seq (from 0, the order), event_type, version. The version never falls. Batches are scanned in blocks, each
    by itself, so the only window over everything has a row a block.
    """
    rows = events.withColumn("batch", F.floor(F.col("seq") / batch).cast("bigint")).groupBy("batch").agg(F.count("*").alias("events"), F.max((F.col("event_type") == "graph.rebuilt").cast("int")).alias("reloads"), F.max(F.when(F.col("event_type") == "graph.rebuilt", F.col("version"))).alias("v"))
    rows = rows.withColumn("block", F.floor(F.col("batch") / BLOCK).cast("bigint"))
    before = rows.groupBy("block").agg(F.max("v").alias("v")).select("block", F.max("v").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.max("v").over(Window.partitionBy("block").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("own", own).join(before, "block").select("batch", "events", "reloads", F.greatest("own", "before").alias("served"))


def backoff_schedule(attempts: int = 3, base_ms: int = 50, jitter_ms: int = 7, most_ms: int = 2000) -> list[int]:
    """Milliseconds to wait before each further attempt."""
    return [min(base_ms * n + jitter_ms * n, most_ms) for n in range(1, attempts)]
