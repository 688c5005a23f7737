"""Streams with state that expires, against the batch rule on the same log: over micro-batches, restarts, and beyond the TTL."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest

from loomgrade.operators import service as V
from loomgrade.operators import state as S
from loomgrade.streaming import jobs

SCHEMA = "session_id string, call_id bigint, at timestamp, repo string, prompt string, scopes array<string>, version bigint, trigger string, found bigint, degraded boolean, reasons array<string>, clear boolean"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def calls(n, gap=60):
    rnd = random.Random(8)
    for i in range(n):
        yield {"session_id": f"s{rnd.randrange(3)}", "call_id": i, "at": (START + timedelta(seconds=gap * i)).isoformat(), "repo": f"r{rnd.randrange(2)}", "prompt": f"p{rnd.randrange(3)}", "scopes": rnd.sample(["project", "global"], 2),
               "version": i // 25, "trigger": "compact" if rnd.random() < 0.1 else None, "found": rnd.randrange(3), "degraded": rnd.random() < 0.1, "reasons": [], "clear": rnd.random() < 0.05}


def drop(folder, rows, start, each=12):
    for i in range(0, len(rows), each):
        file = folder / f"{start + i:04}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows[i : i + each]))
        os.utime(file, (1_700_000_000 + start + i,) * 2)  # the source takes the oldest first


def go(df, out, checkpoint):
    df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("seconds", [(None, None), (240, 600)])
def test_statuses_are_those_of_the_batch(spark, tmp_path, seconds):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = list(calls(60))
    for half in (rows[:36], rows[36:]):  # the second half meets a new query with the first one's checkpoint
        drop(folder, half, half[0]["call_id"])
        go(jobs.resolve(jobs.drops(spark, str(folder), SCHEMA, 1), *seconds), tmp_path / "out", tmp_path / "c")
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("call_id", "status", "reason", "source").collect()}
    want = {tuple(r) for r in V.resolve_status(spark.read.schema(SCHEMA).json(str(folder)), *seconds).select("call_id", "status", "reason", "source").collect()}
    assert got == want and {s for _, s, _, _ in got} >= {"ok", "no_match", "duplicate_suppressed", "degraded"} and "cache" in {s for *_, s in got}


def test_state_is_gone_beyond_the_ttl(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = list(calls(48, gap=600))
    drop(folder, rows, 0)
    go(jobs.resolve(jobs.drops(spark, str(folder), SCHEMA, 1), 300, 300, "1 minute"), tmp_path / "out", tmp_path / "c")
    left = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "c")).count()
    assert left("answered") <= 1 and left("cached") <= 1  # only the last call is younger than the TTL


def test_suppression_is_that_of_the_batch_and_expires(spark, tmp_path):
    schema = "session_id string, repo string, call_id bigint, at timestamp, version bigint"
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"session_id": f"s{i % 2}", "repo": "r", "call_id": i, "at": (START + timedelta(seconds=9 * i)).isoformat(), "version": i // 7} for i in range(24)]
    drop(folder, rows, 0, 5)
    go(jobs.suppress(jobs.drops(spark, str(folder), schema, 1)), tmp_path / "out", tmp_path / "c")
    batch = S.session_suppression(spark.read.schema(schema).json(str(folder)))
    same = lambda df: {tuple(r) for r in df.select("call_id", "suppressed").collect()}
    assert same(spark.read.parquet(str(tmp_path / "out"))) == same(batch)
    go(jobs.suppress(jobs.drops(spark, str(folder), schema, 1), 20, "1 second"), tmp_path / "out2", tmp_path / "c2")
    last, want = {}, set()
    for r in rows:
        t, k = 9 * r["call_id"], r["session_id"]
        hit = k in last and last[k][0] == r["version"] and t - last[k][1] < 20
        want.add((r["call_id"], hit))
        last[k] = last[k] if hit else (r["version"], t)
    assert same(spark.read.parquet(str(tmp_path / "out2"))) == want
