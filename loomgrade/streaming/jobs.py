"""Structured Streaming jobs: the rules of `operators.state`, kept up incrementally and idempotently.

Checkpoints stand in for acknowledgements: a batch that fails is replayed whole. State that may grow for ever is keyed
and lives in the state store, never on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgrade.operators.service import StatusRule, status_rows
from loomgrade.sources.snapshots import Store

MOST_BYTES = 10 * 1024 * 1024


def ingest(requests: DataFrame) -> DataFrame:
    """The first request of each content, for ever; blank and too large ones are left out (see `rejected`)."""
    good = requests.where("trim(coalesce(session_id, '')) <> '' AND trim(coalesce(content, '')) <> ''").where(F.octet_length("content") <= MOST_BYTES)
    return good.withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(["content_hash"])


def rejected(requests: DataFrame) -> DataFrame:
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = F.when(blank("session_id"), "blank_session_id").when(blank("content"), "blank_content").when(F.octet_length("content") > MOST_BYTES, "too_large")
    return requests.withColumn("reason", reason).where("reason IS NOT NULL")


def idempotent(events: DataFrame, key: str = "idempotency_key", time: str = "ts", ttl: str = "1 day") -> DataFrame:
    """Events whose key was not seen within the TTL of event time."""
    return events.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


class _Memory:
    """A map of the state store as `StatusRule` and `remember` use it, with a timer at which each entry is too old."""

    def __init__(self, state, handle, seconds: int | None):
        self.state, self.handle, self.seconds = state, handle, seconds

    def get(self, key):
        return tuple(self.state.getValue((key,))) if self.state.containsKey((key,)) else None

    def __setitem__(self, key, value) -> None:
        self.state.updateValue((key,), value)
        if self.seconds is not None:
            self.handle.registerTimer(value[1] // 1000 + self.seconds * 1000)

    def clear(self) -> None:
        self.state.clear()

    def forget(self, now_ms: int) -> None:
        if self.seconds is not None:
            for key in [k for k, v in self.state.iterator() if v[1] // 1000 + self.seconds * 1000 <= now_ms]:
                self.state.removeKey(key)


class _Sessions(StatefulProcessor):
    """The rule of `resolve_status` for one session; its memories live in the state store."""

    def __init__(self, suppress_seconds: int | None, cache_seconds: int | None):
        self.seconds = suppress_seconds, cache_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answered = _Memory(handle.getMapState("answered", "repo string", "version long, t long"), handle, self.seconds[0])
        self.cached = _Memory(handle.getMapState("cached", "key string", "version long, t long, status string, reason string"), handle, self.seconds[1])
        self.rule = StatusRule(self.answered, self.cached, *self.seconds)

    def handleInputRows(self, key, rows, timerValues):
        own = pd.concat(list(rows)).sort_values(["t", "call_id"])
        made = [(row.call_id, *self.rule(**row._asdict())) for row in own.itertuples(index=False)]
        made = [m for m in made if m[1] is not None]  # all but those that clear
        columns = dict(zip(("call_id", "status", "reason", "source"), map(list, zip(*made, strict=True)), strict=True)) if made else {}
        if columns:
            text = {c: pd.Series(columns[c], dtype=object) for c in ("status", "reason", "source")}
            yield pd.DataFrame({"session_id": pd.Series([key[0]] * len(made), dtype=own["session_id"].dtype), "call_id": columns["call_id"], **text})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        self.answered.forget(now)
        self.cached.forget(now)
        return iter(())

    def close(self) -> None:
        pass


def resolve(calls: DataFrame, suppress_seconds: int | None = 3600, cache_seconds: int | None = 600, late: str = "10 minutes") -> DataFrame:
    """session_id, call_id, status, reason, source of a stream of calls: `operators.service.resolve_status`, kept up live.

    A session's suppressions and cached answers are maps of the state store, which has to be RocksDB's. A row with `clear` empties them. Each
    entry has a timer, so once the watermark (`late` behind the latest call) has passed its time, it is gone: state does not outgrow the calls of
    the seconds that are remembered. None remembers for ever. Calls of a batch are taken in order of time; a call that comes later than the
    watermark is dropped. A batch holds a session's calls in memory, so its trigger bounds them.
    """
    timed = calls.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    rows = status_rows(timed, "at")
    kind = calls.schema["session_id"].dataType.simpleString()
    out = f"session_id {kind}, call_id {calls.schema['call_id'].dataType.simpleString()}, status string, reason string, source string"
    return rows.groupBy("session_id").transformWithStateInPandas(_Sessions(suppress_seconds, cache_seconds), out, "Append", "EventTime")


class _Answered(StatefulProcessor):
    """The version that a session and repository was answered last."""

    def __init__(self, seconds: int | None):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "version long, t long")

    def handleInputRows(self, key, rows, timerValues):
        own = pd.concat(list(rows)).sort_values(["t", "call_id"])
        last, out = self.last.get() if self.last.exists() else None, []
        for t, version in zip(own["t"], own["version"], strict=True):
            out.append(last is not None and version == last[0] and (self.seconds is None or t - last[1] < self.seconds * 1_000_000))
            last = last if out[-1] else (int(version), int(t))
        self.last.update(tuple(last))
        if self.seconds is not None:
            self.handle.registerTimer(last[1] // 1000 + self.seconds * 1000)
        yield pd.DataFrame({**{c: own[c].astype(object) for c in ("session_id", "repo")}, "call_id": own["call_id"], "suppressed": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists() and self.last.get()[1] // 1000 + self.seconds * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def suppress(calls: DataFrame, seconds: int | None = None, late: str = "10 minutes") -> DataFrame:
    """calls (session_id, repo, call_id, version, at) with suppressed: whether the session's last answer had this version.

    A session and repository's state is one version and its time; with `seconds` an answer counts so long and is then cleared
    by a timer on the watermark. The state store has to be RocksDB's.
    """
    timed = calls.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    rows = timed.select("session_id", "repo", "call_id", "version", F.unix_micros("at").alias("t"), "at")
    return rows.groupBy("session_id", "repo").transformWithStateInPandas(_Answered(seconds), "session_id string, repo string, call_id long, suppressed boolean", "Append", "EventTime")


def breaker(calls: DataFrame, threshold: int = 5, open_seconds: float = 30.0) -> DataFrame:
    """calls (provider, call_id, at, ok) with the breaker's state before each and whether it was let through."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values(["at", "call_id"])
        out = []
        for at, ok in zip(rows["at"], rows["ok"], strict=True):
            now = int(pd.Timestamp(at).value // 1000)
            kind = "closed" if opened < 0 else "half_open" if now - opened >= open_seconds * 1e6 else "open"
            out.append(kind)
            if kind == "open":
                continue
            if ok:
                failures, opened = 0, -1
            else:
                failures += 1
                if kind == "half_open" or failures >= threshold:
                    opened = now
        state.update((int(failures), int(opened)))
        yield pd.DataFrame({"provider": rows["provider"], "call_id": rows["call_id"], "state": out, "allowed": [k != "open" for k in out]})

    return calls.groupBy("provider").applyInPandasWithState(walk, "provider string, call_id long, state string, allowed boolean", "failures long, opened long", "append", GroupStateTimeout.NoTimeout)


def relay(outbox: DataFrame, deliver: Callable[[DataFrame], None], checkpoint: str, time: str | None = None, ttl: str = "1 day"):
    """Deliver each batch's vector events, the last of each point; other types never pass. Runs until what is there is done.

    A key is delivered once, whichever batches repeat it: its state is kept for ever, or within the TTL of event time if `time`
    names its column. A failed delivery replays the batch, so `deliver` must be idempotent, as an upsert by point is.
    """
    from loomgrade.operators.state import latest_by_point

    own = outbox.where("event_type = 'vector.upsert' AND trim(idempotency_key) <> ''")
    once = idempotent(own, time=time, ttl=ttl) if time else own.dropDuplicates(["idempotency_key"])

    def batch(rows: DataFrame, _: int) -> None:
        deliver(latest_by_point(rows))

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def served_version(spark: SparkSession, checkpoint: str) -> int:
    """The version that `refresh` has loaded last, 0 before the first."""
    return max((int(n) for n, _ in Store(spark, f"{checkpoint}/served").names()), default=0)


def refresh(events: DataFrame, reload: Callable[[int], None], checkpoint: str):
    """Reload once for each batch that says the graph was rebuilt, to its latest version, which never falls.

    The served version stands beside the checkpoint, so a restart neither falls back nor loads again what is served. It is
    noted after the reload: a crash between the two loads the version once more.
    """
    spark = events.sparkSession
    store = Store(spark, f"{checkpoint}/served")

    def batch(rows: DataFrame, _: int) -> None:
        latest = rows.where("event_type = 'graph.rebuilt'").agg(F.max("version")).first()[0]
        if latest is not None and latest > served_version(spark, checkpoint):
            reload(latest)
            store.create(f"{latest}", "")
            for name, _ in store.names():
                if int(name) < latest:
                    store.delete(name)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drops(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    """Rows of JSON files dropped into a folder: the ingest source, oldest files first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)
