"""Files in and out, and streaming jobs against the batch results of the same rules."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgrade.operators import state as S
from loomgrade.sources import drafts as D
from loomgrade.sources import files as A
from loomgrade.streaming import jobs

SKILL = "---\nname: rust-io\ndescription: \"Reads files\"\ntags:\n  - rust\n  - io\n---\n# Title\nplain line\n## Procedures\n- open it\n- read it\n## Conventions\n- close it\n"


def write(root, path, text):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def test_skill_scan_and_parse(spark, tmp_path):
    write(tmp_path, "a/SKILL.md", SKILL)
    write(tmp_path, "b/SKILL.md", "first words\ntags: x, y\n- note\n")
    write(tmp_path, "c/skill.MD", "# Old\n")
    write(tmp_path, "c/SKILL.md.retired", "retired: true")
    write(tmp_path, "target/d/SKILL.md", "no")
    write(tmp_path, "b/README.md", "no")
    got = {r.path.split("/")[-2]: r for r in A.parse_skills(A.skill_files(spark, [str(tmp_path)])).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.name, a.description, a.tags) == ("rust-io", "Reads files", ["rust", "io"])
    assert [(s.position, s.kind, s.title, s.content) for s in a.subunits] == [(0, "procedure", "Procedure note", "open it"), (1, "procedure", "Procedure note", "read it"), (2, "convention", "Convention note", "close it")]
    assert (b.name, b.description, b.tags, [s.kind for s in b.subunits]) == ("SKILL", "first words", ["x", "y"], ["summary"])
    assert A.fingerprints(spark, [str(tmp_path)]).count() == 4


def test_upserts_drafts_and_audits(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "point_id bigint, vec array<double>, at bigint")
    got = {r.point_id: r.vec for r in A.upsert_vectors(rows((1, [1.0], 1), (2, [2.0], 9)), rows((1, [3.0], 1), (2, [4.0], 8))).collect()}
    assert got == {1: [3.0], 2: [2.0]}
    drafts = spark.createDataFrame([("x", "X y", "d", ["t"], "odd", ["p"], [])], "slug string, name string, description string, tags array<string>, generality string, procedures array<string>, conventions array<string>")
    page = A.draft_markdown(drafts).first()
    assert page.path == "x/SKILL.md.pending" and "generality: uncertain" in page.markdown and "## Procedures\n- p\n" in page.markdown and "Conventions" not in page.markdown


def test_transcript_files(spark, tmp_path):
    write(tmp_path, "s.jsonl", '{"role": "user", "content": "hi"}\n\n{"role": "assistant", "content": "yes"}\n')
    lines = A.transcripts(spark, str(tmp_path))
    assert [(r.line, r.speaker) for r in A.strict_transcript(lines).orderBy("line").collect()] == [(0, "user"), (2, "assistant")]


def test_large_transcripts_are_read_in_ranges(spark, tmp_path):
    """Lines of two files over many tasks are numbered as if each file were read at once; odd ends, blank lines, other line ends."""
    texts = {"a.jsonl": "".join(f'{{"role": "user", "content": "{i} {"x" * (i % 97)}"}}\n' for i in range(4000)), "b.jsonl": "\n\n" + "y\u2028\r\n" * 900 + "last"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = A.transcripts(spark, str(tmp_path))
        got = {n: {r.line: r.json for r in lines.where(F.col("session_id").endswith(n)).collect()} for n in texts}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for n, text in texts.items():
        assert got[n] == dict(enumerate(text.removesuffix("\n").split("\n")))


def test_strict_transcripts_name_what_is_wrong(spark, tmp_path):
    write(tmp_path, "good.jsonl", '{"role": "user", "content": "hi"}\n')
    write(tmp_path, "none.jsonl", '{"role": "user"}\n\n')
    assert [r.session_id.split("/")[-1] for r in A.without_entries(A.transcripts(spark, str(tmp_path))).collect()] == ["none.jsonl"]
    write(tmp_path, "bad.jsonl", '{"role": "user", "content": "hi"}\n{not\n')
    with pytest.raises(Exception, match="bad.jsonl, line 1"):
        A.strict_transcript(A.transcripts(spark, str(tmp_path))).collect()


def files_of(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and not p.name.startswith(".") and not p.name.endswith(".crc")}


def test_a_batch_of_drafts_is_all_or_nothing(spark, tmp_path):
    """A writer dies before each step in turn: afterwards the old files are whole, or the new ones are once the batch was decided."""
    old = {"a/SKILL.md.pending": "old a", "keep/SKILL.md": "kept"}
    new = {"a/SKILL.md.pending": "new a", "b/SKILL.md.pending": "new b", "c/SKILL.md.pending": ""}
    rows = spark.createDataFrame(list(new.items()), "path string, markdown string").coalesce(1)
    steps: list[str] = []
    root = tmp_path / "all"
    assert D.write_drafts(rows, str(root), steps.append) == sorted(new) and files_of(root) == new
    assert steps == ["stage 0", "stage 1", "stage 2", "decide", "move 0", "move 1", "move 2", "forget"]
    for k, dies in enumerate(steps):
        root = tmp_path / f"at{k}"
        for path, text in old.items():
            write(root, path, text)

        def step(name, dies=dies):
            if name == dies:
                raise KeyboardInterrupt

        with pytest.raises(KeyboardInterrupt):
            D.write_drafts(rows, str(root), step)
        ended = D.recover(spark, str(root), grace_seconds=-60)
        decided = k > steps.index("decide")
        assert files_of(root) == (old | new if decided else old) and len(ended) == decided, dies


def test_tombstones_and_repeats_are_errors(spark, tmp_path):
    write(tmp_path, "b/SKILL.md.rejected", "no")
    rows = lambda *x: spark.createDataFrame([(p, "t") for p in x], "path string, markdown string")
    with pytest.raises(D.Rejected, match="b/SKILL.md"):
        D.write_drafts(rows("a/SKILL.md.pending", "b/SKILL.md.pending"), str(tmp_path))
    with pytest.raises(ValueError, match="more than once"):
        D.write_drafts(rows("a/SKILL.md.pending", "a/SKILL.md.pending"), str(tmp_path))
    assert files_of(tmp_path) == {"b/SKILL.md.rejected": "no"} and D.write_drafts(rows().where("false"), str(tmp_path)) == []


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def dropped(spark, tmp_path, rows, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(0, len(rows), 3):
        file = folder / f"{i:03}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows[i : i + 3]))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # the source takes the oldest first
    return jobs.drops(spark, str(folder), schema, 1)


def test_ingest_stream_is_the_batch(spark, tmp_path):
    rows = [{"id": i, "session_id": "s" if i % 4 else " ", "content": f"c{i % 3}"} for i in range(9)]
    stream = dropped(spark, tmp_path, rows, "id bigint, session_id string, content string")
    got = {r.content_hash for r in run(jobs.ingest(stream), "ingested").collect()}
    batch = S.ingest(spark.createDataFrame([(r["id"], r["session_id"], r["content"]) for r in rows], "id bigint, session_id string, content string"))
    assert got == {r.content_hash for r in batch.where("outcome = 'enqueued'").collect()} and run(jobs.rejected(stream), "refused").count() == 3


def test_ttl_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [{"idempotency_key": k, "ts": (t + timedelta(hours=h)).isoformat()} for k, h in (("a", 0), ("a", 1), ("b", 2))]
    stream = dropped(spark, tmp_path, rows, "idempotency_key string, ts timestamp")
    assert sorted(r.idempotency_key for r in run(jobs.idempotent(stream), "once").collect()) == ["a", "b"]


def test_breaker_stream_is_the_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [{"provider": "p", "session_id": "s", "repo": "r", "call_id": i, "at": (t + timedelta(seconds=9 * i)).isoformat(), "ok": i % 5 == 4, "version": i // 4} for i in range(12)]
    schema = "provider string, session_id string, repo string, call_id bigint, at timestamp, ok boolean, version bigint"
    stream = dropped(spark, tmp_path, rows, schema)
    batch = spark.read.schema(schema).json(str(tmp_path / "in"))
    same = lambda a, b, c: {tuple(r) for r in a.select("call_id", c).collect()} == {tuple(r) for r in b.select("call_id", c).collect()}
    assert same(run(jobs.breaker(stream, 2, 30.0), "breaks"), S.circuit_breaker(batch, 2, 30.0), "state")


def test_relay_and_refresh(spark, tmp_path):
    rows = [{"event_type": k, "idempotency_key": f"k{i}", "point_id": 1, "event_id": i, "occurred_at": f"2024-01-0{i + 1}T00:00:00", "version": i} for i, k in enumerate(["vector.upsert", "vector.upsert", "graph.rebuilt", "other"])]
    stream = dropped(spark, tmp_path, rows, "event_type string, idempotency_key string, point_id bigint, event_id bigint, occurred_at timestamp, version bigint")
    sent, loads = [], []
    jobs.relay(stream, lambda df: sent.extend(r.event_id for r in df.collect()), str(tmp_path / "c1")).awaitTermination()
    jobs.refresh(stream, loads.append, str(tmp_path / "c2")).awaitTermination()
    assert sent == [1] and loads == [2] and jobs.served_version(spark, str(tmp_path / "c2")) == 2


def test_relay_and_refresh_survive_restarts(spark, tmp_path):
    """Later batches repeat a delivered key, and tell of an older version: neither passes, nor after a restart."""
    schema = "event_type string, idempotency_key string, point_id bigint, event_id bigint, occurred_at timestamp, version bigint"
    folder = tmp_path / "in"
    folder.mkdir()
    sent, loads = [], []

    def go(n, *rows):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("event_type", "idempotency_key", "point_id", "event_id", "occurred_at", "version"), r, strict=True))) for r in rows))
        jobs.relay(jobs.drops(spark, str(folder), schema, 1), lambda df: sent.extend(r.event_id for r in df.collect()), str(tmp_path / "c1")).awaitTermination()
        jobs.refresh(jobs.drops(spark, str(folder), schema, 1), loads.append, str(tmp_path / "c2")).awaitTermination()

    at = "2024-01-01T00:00:00"
    go(1, ("vector.upsert", "a", 1, 1, at, 0), ("graph.rebuilt", "g1", 0, 2, at, 5))
    go(2, ("vector.upsert", "a", 1, 3, at, 0), ("vector.upsert", "b", 1, 4, at, 0), ("graph.rebuilt", "g2", 0, 5, at, 4))
    go(3, ("graph.rebuilt", "g3", 0, 6, at, 5), ("vector.upsert", "b", 2, 7, at, 0))
    go(4, ("graph.rebuilt", "g4", 0, 8, at, 9))
    assert sent == [1, 4] and loads == [5, 9]


def test_llm_is_optional(monkeypatch):
    import builtins
    import importlib
    import sys

    import __spark_entry__

    real = builtins.__import__

    def missing(name, *a, **k):
        if name == "corpus_pipeline" or name.startswith("loomgrade.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a, **k)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("loomgrade.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", missing)
    try:
        assert not any(n.startswith("op") and n[2].isdigit() for n in importlib.reload(__spark_entry__).queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
