"""Hand-worked cases of the service's operators and of callers' models."""

import json

import pytest
from pyspark.sql import functions as F

from loomgrade.operators import retrieval as R
from loomgrade.operators import service as V


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def strings(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def test_tunables():
    c = R.configured({"RETRIEVAL_MAX_RESULTS": " 7 ", "RETRIEVAL_ALPHA": "", "RETRIEVAL_COMMUNITY_BOOST_MODE": "Affinity", "RETRIEVAL_RRF_K": "10"})
    assert (c.results, c.alpha, c.boost_mode, c.rrf_k) == (7, R.DEFAULTS.alpha, "centroid", 10.0) and len(R.TUNABLES) == 14
    for name, wrong in (("RETRIEVAL_MAX_RESULTS", "many"), ("RETRIEVAL_COMMUNITY_BOOST_MODE", "x"), ("RETRIEVAL_MAX_RESULTS", "0")):
        with pytest.raises(ValueError):
            R.configured({name: wrong})


def test_boosts(spark):
    found = spark.createDataFrame([(1, 10, [1.0, 0.0]), (1, 11, [1.0, 0.0]), (1, 12, [1.0, 0.0])], "query_id bigint, skill_id bigint, qvec array<double>")
    members = spark.createDataFrame([(10, "a", [1.0, 0.0]), (11, "b", [-1.0, 0.0]), (10, "c", [0.0, 1.0])], "skill_id bigint, community_id string, vec array<double>")
    boost = lambda mode, m=members: {r.skill_id: r.community_boost for r in R.community_boost(found, mode, m).collect()}
    assert boost("off") == {10: 0.0, 11: 0.0, 12: 0.0} == boost("centroid", None)
    assert boost("binary") == {10: 0.2, 11: 0.2, 12: 0.0} and boost("centroid") == {10: 1.0, 11: 0.0, 12: 0.0}


def test_remembered_answers_end_with_their_time(spark):
    rows = [(1, 0, "p", False), (2, 50, "p", False), (3, 70, "p", False), (4, 90, "q", True), (5, 95, "p", False)]
    calls = spark.createDataFrame(rows, "call_id bigint, s bigint, prompt string, clear boolean").selectExpr(
        "call_id", "'x' AS session_id", "timestamp_seconds(s) AS at", "'r' AS repo", "prompt", "array('global') AS scopes", "1L AS version", "CAST(NULL AS STRING) AS trigger", "1 AS found", "false AS degraded", "array() AS reasons", "clear"
    )
    got = {r.call_id: (r.status, r.source) for r in V.resolve_status(calls, 60, 600).collect()}
    assert got == {1: ("ok", "retrieval"), 2: ("duplicate_suppressed", "suppression"), 3: ("ok", "cache"), 5: ("ok", "retrieval")}


def test_scopes_and_reasons(spark):
    none = strings()
    r = values(
        spark,
        both=V.scopes_considered(strings("global"), strings("project"), none),
        rest=V.scopes_considered(none, none, strings("team")),
        why=V.degraded_outcome(strings("b", "a", "b"), none, strings("project")),
        plain=V.degraded_outcome(none, strings("global", "global"), strings("project")),
    )
    assert r.both == ["project", "global"] and r.rest == ["team"]
    assert (r.why.reason, r.why.reasons, r.why.degraded) == ("b", ["b", "a"], ["project"]) and (r.plain.reason, r.plain.degraded) == ("retrieval_degraded", ["global"])


def test_usage_records_of_uuids_only(spark):
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    rows = spark.createDataFrame([("s", "p", "", "ok", [(uuid, 0.5), ("skill", 0.4)]), ("s", None, "/r", "no_match", [])], "session_id string, prompt string, repo string, status string, skills array<struct<skill_id:string,score:double>>")
    (one,) = V.usage_records(rows).collect()
    assert (one.scope, one.skill_id, one.relevance, len(one.prompt_hash)) == ("global", uuid, 0.5, 16)


def test_illegal_moves_are_named(spark):
    rows = spark.createDataFrame([("pending",), ("processing",), (None,)], "status string")
    assert [(r.status, r.error) for r in V.transition(rows, "claim").collect()] == [("processing", None), ("processing", "cannot claim: status is processing"), (None, "cannot claim: status is null")]


def test_checks(spark):
    r = values(
        spark,
        ok=V.reference_error(F.lit("a/b.jsonl"), F.lit(None).cast("string")),
        blank=V.reference_error(F.lit("  "), F.lit(None).cast("string")),
        up=V.reference_error(F.lit("a/../b"), F.lit(None).cast("string")),
        top=V.reference_error(F.lit("/a"), F.lit(None).cast("string")),
        folder=V.reference_error(F.lit("a/"), F.lit(None).cast("string")),
        long=V.reference_error(F.lit(None).cast("string"), F.repeat(F.lit("x"), 20), 10),
        write=V.may_write(F.lit("/w/a"), strings("/w")),
        climb=V.may_write(F.lit("/w/../a"), strings("/w")),
        no=V.may_write(F.lit("/wa"), strings("/w")),
        none=V.may_write(F.lit("/w"), strings()),
        id=V.identifier(F.lit(" a-b ")),
        bad=V.identifier(F.lit("a b")),
        view=V.contract_view(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"))),
    )
    assert (r.ok, r.write, r.climb, r.no, r.none, r.id, r.bad) == (None, True, False, False, False, "a-b", None)
    assert "blank" in r.blank and "traversal" in r.up and "absolute" in r.top and "file" in r.folder and "large" in r.long and json.loads(r.view) == {"a": 1, "b": None}


def test_preamble_drops_paths_then_conventions_then_preferences(spark):
    lists = strings("p" * 9, "q" * 9), strings("c" * 9), strings(" " + "s" * 9)
    none = F.lit(None).cast("string")
    kept = {t: values(spark, x=V.capped_preamble(none, none, *lists, t)).x for t in (30, 28, 25, 14, 9, 0)}
    sizes = {t: (len(x.paths), len(x.conventions), len(x.preferences)) for t, x in kept.items()}
    assert sizes == {30: (2, 1, 1), 28: (2, 1, 1), 25: (1, 1, 1), 14: (0, 0, 1), 9: (0, 0, 0), 0: (0, 0, 0)}
    assert kept[30].text == "[Project facts]\nKey paths: ppppppppp, qqqqqqqqq\nConvention: ccccccccc\n\n[Standing user preferences]\n- sssssssss"
    assert all(x.tokens == -(-len(x.text) // 4) <= t for t, x in kept.items())
    full = values(spark, x=V.capped_preamble(F.lit("r" * 99), F.lit("Go"), *lists, 20)).x
    assert full.text == "" and full.tokens == 0 and not full.preferences


def test_callers_models(spark):
    rows = spark.createDataFrame([(i, "ab" * i) for i in range(1, 6)], "id bigint, text string")
    got = V.embed(rows, lambda texts: [[len(t), 1] for t in texts], batch=2, most_chars=6).orderBy("id").collect()
    assert [r.vec for r in got] == [[2.0, 1.0], [4.0, 1.0], [6.0, 1.0], [6.0, 1.0], [6.0, 1.0]]
    for texts, model in (([" "], lambda t: [[1.0]] * len(t)), (["a"], lambda t: [])):
        with pytest.raises(Exception, match="blank|vectors"):
            V.embed(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    windows = spark.createDataFrame([(1, 0, "x" * 120), (1, 1, "short"), (1, 2, "y" * 120)], "session_id bigint, window bigint, text string")
    asked: list = []

    def model(text):
        asked.append(text)
        if text[0] == "y":
            raise ValueError("malformed")
        return [{"name": "n", "confidence": 0.5}] if len(asked) > 1 else []

    found = V.extract(windows.coalesce(1), model, "name string, confidence double").collect()
    assert [(r.window, r.nr, r.name) for r in found] == [(0, 0, "n"), (1, 0, "n")]


def test_projections(spark):
    steps = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "win bigint, step bigint, command string")
    labels = spark.createDataFrame([(1, "n", "d", True), (2, "m", "d", False)], "win bigint, name string, description string, keep boolean")
    assert [(r.name, r.procedures) for r in V.skeleton_candidates(steps, labels, ["win"]).collect()] == [("n", ["a", "b"])]
    events = spark.createDataFrame([(1, 0, "x"), (1, 4, "y")], "s bigint, position bigint, content string")
    episodes = spark.createDataFrame([(1, 7, [4, 9, 0])], "s bigint, episode bigint, indices array<bigint>")
    assert [r.content for r in V.episode_events(episodes, events, ["s"]).orderBy("nr").collect()] == ["y", "x"]
    answers = spark.createDataFrame([(1, 0, " Use TABS "), (1, 1, "  "), (1, 2, "other")], "s bigint, nr bigint, statement string")
    originals = spark.createDataFrame([(1, 0, "please use tabs always", "general"), (1, 1, "use tabs", "uncertain")], "s bigint, nr bigint, statement string, generality string")
    assert {(r.statement, r.generality) for r in V.normalised(answers, originals, ["s"]).collect()} == {("Use TABS", "general"), ("other", "uncertain")}
    r = values(spark, few=V.with_fallback(strings("a"), strings("f")), enough=V.with_fallback(strings("a", "b"), strings("f")), null=V.with_fallback(F.lit(None).cast("array<string>"), strings("f")))
    assert (r.few, r.enough, r.null) == (["a", "f"], ["a", "b"], ["f"])
    skills = spark.createDataFrame([(1, "active", None), (2, "retired", None)], "skill_id bigint, lifecycle string, updated_at timestamp")
    assert [x.skill_id for x in V.active(skills).collect()] == [1]
    assert {x.skill_id for x in V.touched(skills, F.col("skill_id") == 2, "2024-01-01 00:00:00").where("updated_at IS NOT NULL").collect()} == {2}


def test_a_clock_between_the_last_run_and_the_last_tick_is_not_due(spark):
    ticks = spark.createDataFrame([("j", i, t) for i, t in enumerate((100, 150, 120, 90, 160))], "job string, tick_id bigint, t bigint")
    assert [r.outcome for r in V.cron_ticks(ticks, 60).orderBy("tick_id").collect()] == ["run", "wait", "wait", "error", "run"]
