"""Hand-worked cases: formulas, edges, and rules that the star-schema tables do not reach."""

import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrade.functions import text as X
from loomgrade.functions import vectors as V
from loomgrade.operators import graph as G
from loomgrade.operators import maintenance as M
from loomgrade.operators import metrics as Q
from loomgrade.operators import retrieval as R
from loomgrade.operators import state as S
from loomgrade.operators import transcripts as T
from loomgrade.operators.components import components


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_defaults_of_ranking():
    c = R.DEFAULTS
    assert (c.alpha, c.beta, c.gamma, c.boost, c.floor, c.diversity, c.rrf_k, c.results, c.candidates, c.subunits) == (0.45, 0.35, 0.20, 0.25, 0.48, 0.65, 60.0, 3, 50, 3)
    with pytest.raises(ValueError):
        R.Config(results=0)


def test_cosine_edges(spark):
    r = one(spark, same=V.cosine(array(1, 2), array(2, 4)), short=V.cosine(array(1), array(1, 2)), zero=V.cosine(array(0, 0), array(1, 2)), empty=V.cosine(F.array().cast("array<double>"), F.array().cast("array<double>")))
    assert (round(r.same, 9), r.short, r.zero, r.empty) == (1.0, 0.0, 0.0, 0.0)
    with pytest.raises(Exception, match="norm zero"):
        one(spark, x=V.strict_cosine(array(0, 0), array(1, 2)))


def test_hashing_embedding_is_unit(spark):
    r = one(spark, v=V.hashing_embedding(X.words(F.lit("one two two three")), 32), none=V.hashing_embedding(X.words(F.lit("")), 32))
    assert len(r.v) == 32 and math.isclose(sum(x * x for x in r.v), 1.0, rel_tol=1e-6) and not any(r.none)


def test_tokenizers(spark):
    r = one(spark, t1=X.words(F.lit("Über-Straße, über 12!")), t2=X.label_words(F.lit("The 123 ab café café using Tools")), t3=X.blank_words(F.lit(" a  A a ")), none=X.words(F.lit(None).cast("string")))
    assert r.t1 == ["über", "straße", "12"] and r.t2 == ["café", "café", "tools"] and r.t3 == ["a", "A"] and r.none == []


def test_three_places_are_those_of_the_binary_value(spark):
    """0.1235 lies below its half and 0.1245 above, 0.0625 on it."""
    halves = [(2 * k + 1) / 2000 for k in range(3000)]
    xs = [0.1235, 0.1245, 0.0625, 0.1875, 0.0, 1.0, 0.016393, *halves, *np.nextafter(halves, 0).tolist(), *np.nextafter(halves, 9).tolist()]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", X.three_places(F.col("x")).alias("s")).collect()
    assert [(r.x, r.s) for r in rows if r.s != f"{r.x:.3f}"] == []


def test_overlap_is_asymmetric(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("x"))
    r = one(spark, l=X.overlap(a, b), r=X.overlap(b, a), j=X.jaccard(a, b), e=X.overlap(F.array().cast("array<string>"), b))
    assert (r.l, r.r, r.j, r.e) == (0.5, 1.0, 0.5, 0.0)


def test_slug_and_estimate(spark):
    r = one(spark, s=X.slugify(F.lit("  Hello, World!  "), "none"), f=X.slugify(F.lit("éé"), "none"), t=X.token_estimate(F.lit("")), u=X.token_estimate(F.lit("éééé")))
    assert (r.s, r.f, r.t, r.u) == ("hello-world", "none", 1, 2)


def test_score_formula(spark):
    row = R.weighted_score(spark.sql("SELECT 0.8D cosine, 0.5D evidence, 0.1D prior, 0.2D community_boost")).first()
    assert math.isclose(row.score, (0.45 * 0.8 + 0.35 * 0.5 + 0.2 * 0.1) * (1 + 0.25 * 0.2), abs_tol=1e-6)


def test_prior_fades_and_is_capped(spark):
    usage = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2023, 1, 1))], "skill_id bigint, used_at timestamp")
    got = {r.skill_id: r.prior for r in R.usage_prior(usage, "2024-01-31 12:00:00").collect()}
    assert got[1] == 0.15 and math.isclose(got[2], math.log(2) * math.exp(-395 / 30), abs_tol=1e-6)


def test_scope_paths_by_component(spark):
    roots = F.array(F.lit("/a/b"))
    case = lambda *p: R.under(F.array(*[F.lit(x) for x in p]) if p else F.array().cast("array<string>"), roots)
    r = one(spark, inside=case("/a/b/c"), same=case("/a/b"), near=case("/a/bc"), mixed=case("/a/b/c", "/x"), none=case())
    assert (r.inside, r.same, r.near, r.mixed, r.none) == (True, True, False, False, False)


def test_fusion_sums_scopes_and_skips_weightless(spark):
    rows = spark.createDataFrame([(1, "project", 7, 1, 0.5, 0.5, 0.1), (1, "global", 7, 1, 0.9, 0.6, 0.2), (1, "global", 8, 2, 0.8, 0.6, 0.2)], "query_id bigint, scope string, skill_id bigint, rank int, score double, cosine double, lexical double")
    got = {r.skill_id: r for r in R.fuse(rows).collect()}
    assert math.isclose(got[7].rrf, 1 / 61 + 0.7 / 61, abs_tol=1e-8) and got[7].scope == "global" and got[7].position == 1
    assert {r.skill_id for r in R.fuse(rows, R.Config(global_weight=0.0)).collect()} == {7}
    assert math.isclose({r.skill_id: r.rrf for r in R.fuse(rows, R.Config(rrf_k=-1.0)).collect()}[8], 0.7 / 62, abs_tol=1e-8)


def test_mmr_prefers_what_is_different(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 1, [1.0, 0.0]), (1, 2, 0.89, 2, [1.0, 0.01]), (1, 3, 0.6, 3, [0.0, 1.0])], "query_id bigint, skill_id bigint, score double, rank int, vec array<double>")
    got = [r.skill_id for r in R.mmr(rows, ["query_id"]).orderBy("mmr_rank").collect()]
    assert got == [1, 3, 2]
    assert [r.skill_id for r in R.mmr(rows, ["query_id"], R.Config(diversity=1.0)).orderBy("mmr_rank").collect()] == [1, 2, 3]


def test_queries_go_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "skill_id bigint, vec array<double>")
    q = rows.select(F.col("skill_id").alias("query_id"), F.col("vec").alias("qvec"))
    whole = {tuple(r) for r in q.crossJoin(rows).select("query_id", "skill_id").collect()}
    assert {tuple(r) for r in R.in_blocks(q, lambda b: rows.crossJoin(b).select("query_id", "skill_id"), block=6).collect()} == whole


def test_cosine_topk_against_all_pairs(spark):
    """Blocks of few bytes, ties, groups, and vectors that are like nothing: null, empty, zero, not finite, of another length."""
    rng = np.random.default_rng(6)
    vectors = [*rng.normal(size=(60, 3)).round(1).tolist(), None, [], [0.0, 0.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 1.0], [1.0, None, 1.0], *([[1.0, 0.0, 0.0]] * 5)]
    data = [(i, v, "even" if i % 2 == 0 else None) for i, v in enumerate(vectors)]
    rows = spark.createDataFrame(data, "skill_id bigint, vec array<double>, scope string").repartition(5)
    asked = rows.where("skill_id % 3 = 0 OR skill_id > 58").select(F.col("skill_id").alias("query_id"), F.col("vec").alias("qvec"))

    def like(a, b):
        fine = lambda v: v and None not in v and np.isfinite(v).all() and any(v)
        if not fine(a) or not fine(b) or len(a) != len(b):
            return 0.0
        return max(0.0, float(np.floor(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) * 1e6 + 0.5) / 1e6))

    for k, by in ((4, ("query_id",)), (3, ("query_id", "scope")), (None, ("query_id",))):
        want = set()
        for q in [i for i in range(len(data)) if i % 3 == 0 or i > 58]:
            for group in {g for *_, g in data} if len(by) > 1 else [...]:
                own = sorted((-like(vectors[q], v), i) for i, v, g in data if group is ... or g == group)
                want |= {(q, i, -c) for c, i in own[:k]}
        for most in (1 << 20, 200):
            got = R.cosine_topk(asked, rows, k, by, most)
            assert {(r.query_id, r.skill_id, r.cosine) for r in got.collect()} == want, (k, by, most)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components(spark, links):
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, {a}).add(b)
            near.setdefault(b, {b}).add(a)
    changed = True
    while changed:
        changed = False
        for s in near.values():
            more = set().union(*(near[x] for x in s))
            if more - s:
                s |= more
                changed = True
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: min(s) for x, s in near.items()}
    rounds = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint"), finish=0, hot=3).collect()}
    assert rounds == got


@pytest.mark.parametrize("n,finish", [(10_000, 1_000_000), (3_000, 300), (400, 0)])
def test_components_of_shuffled_paths(spark, n, finish):
    """Rounds do not grow with a path's length; a second path of strings stays apart."""
    order = np.random.default_rng(n).permutation(n)
    links = [(f"p{a:06d}", f"p{b:06d}") for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)] + [("q1", "q0"), ("q1", "q1"), ("q1", None)]
    got = components(spark.createDataFrame(links, "a string, b string"), finish=finish, hot=50).groupBy("root").count().collect()
    assert {(r.root, r["count"]) for r in got} == {("p000000", n), ("q0", 2)}


def test_components_of_a_hub(spark):
    links = [(2_000, i) for i in range(2_000)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), finish=0, hot=100).select("root").distinct().collect()
    assert [r.root for r in got] == [0]
    assert components(spark.createDataFrame([], "a bigint, b bigint"), finish=0).count() == 0


def test_similar_pairs_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "skill_id bigint, vec array<double>")
    n = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(n[i] @ n[j]), 6) >= 0.8}
    assert {(r.a, r.b) for r in G.similar_pairs(rows, 0.8).collect()} == want
    ceil = np.ceil
    monkeypatch.setattr(G.np, "ceil", lambda x: ceil(x * 100))
    assert {(r.a, r.b) for r in G.similar_pairs(rows, 0.8).collect()} == want


def test_taken_label_gets_a_term_more(spark):
    scores = spark.createDataFrame([(c, t, s) for c in (1, 2, 3) for t, s in (("aa", 3.0), ("bb", 2.0), ("cc", 1.0))], "cluster int, term string, score double")
    scopes = spark.createDataFrame([(1, "project", 10), (2, "project", 20), (3, "project", 30), (4, "project", 40)], "cluster int, scope string, first_member bigint")
    got = {r.cluster: r.label for r in G.cluster_labels(scores, scopes).collect()}
    assert got == {1: "project-cluster-aa-bb", 2: "project-cluster-aa-bb-cc", 3: "project-cluster-aa-bb-cc-30", 4: "project-cluster-4"}


def test_project_root(spark):
    root = lambda *p: G.project_root_key(F.array(*[F.lit(x) for x in p]) if p else F.array().cast("array<string>"))
    r = one(spark, usual=root("/home/me/app/.skills/cargo/SKILL.md"), named=root("/w/app/my-skills/x/SKILL.md"), bare=root("/app/x/SKILL.md"), none=root())
    assert (r.usual, r.named, r.bare, r.none) == ("/home/me/app", "/w/app", "/app", None)


def test_usage_rate(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 31), 3), (1, datetime(2023, 12, 17), 2), (2, datetime(2022, 1, 1), 9)], "skill_id bigint, used_at timestamp, n int")
    got = {r.skill_id: r.rate for r in M.usage_rates(rows, "2024-01-31 00:00:00", 90).collect()}
    assert math.isclose(got[1], (3 + 2 * 0.5) / 3, abs_tol=1e-6) and got[2] == 0.0
    assert {r.skill_id for r in M.retirement_proposals(rows, "2024-01-31 00:00:00").collect()} == {2}


def test_future_and_missing_dates_fall_back(spark):
    rows = spark.createDataFrame([("2030-01-01", datetime(2024, 1, 1)), ("no", datetime(2024, 1, 2)), (None, datetime(2024, 1, 3)), ("2024-01-04", datetime(2023, 1, 1))], "created string, mtime timestamp")
    got = [r.created_at.day for r in M.lifecycle_dates(rows, "2024-02-01 00:00:00").collect()]
    assert got == [1, 2, 3, 4]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3), (1, 7, 4)], "query_id bigint, skill_id bigint, rank int")
    relevant = spark.createDataFrame([(1, 6), (1, 9), (2, 1)], "query_id bigint, skill_id bigint")
    got = {r.query_id: r for r in Q.per_query(ranked, relevant, 3).collect()}
    r = got[1]  # repeated ids count once, so id 6 stands second
    assert (round(r.precision_at_k, 4), r.recall_at_k, r.reciprocal_rank, r.average_precision, r.hit_at_k) == (0.3333, 0.5, 0.5, 0.25, True)
    assert math.isclose(r.ndcg_at_k, (1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs_tol=1e-6) and got[2].reciprocal_rank == 0.0


LINES = [
    '{"type": "user", "message": {"content": " hi "}}',
    "",
    "{not json",
    '{"type": "assistant", "message": {"content": [{"type": "text", "text": "yes"}, {"type": "thinking", "thinking": "x"}, {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/a"}}]}}',
    '{"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "Exit code 2\\nbad"}, {"type": "text", "text": "no"}]}}',
    '{"type": "user", "message": {"content": 5}}',
    '{"type": "message", "message": {"role": "assistant", "content": [{"text": "a"}, {"text": "b"}]}}',
    '{"speaker": "user", "content": "old"}',
    '{"type": "summary"}',
    '{"type": "assistant"}',
]


def test_events_of_lines(spark):
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(LINES)], "session_id string, line int, json string")
    got = [(r.line, r.part, r.kind, r.content or r.path or r.name or r.exit_code, r.malformed) for r in T.parse_events(rows).orderBy("line", "part").collect()]
    assert got == [
        (0, 0, "user", "hi", False),
        (2, 0, "user", "[unparseable line 3]", True),
        (3, 0, "assistant", "yes", False),
        (3, 1, "file_edit", "/a", False),
        (3, 2, "tool_call", "Edit", False),
        (4, 0, "tool_result", 2, False),
        (5, 0, "user", "[unexpected content shape on line 6]", True),
        (6, 0, "assistant", "a b", False),
        (7, 0, "user", "old", False),
        (8, 0, "metadata", "summary", False),
    ]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=20), st.integers(1, 40), st.integers(0, 3))
def test_windows_cover_everything(spark, tokens, budget, overlap):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(tokens)], "session_id bigint, position bigint, tokens bigint")
    got = [(r["first"], r["size"]) for r in T.budget_windows(rows, budget, overlap).orderBy("window").collect()]
    assert {p for a, n in got for p in range(a, a + n)} == set(range(len(tokens)))
    assert all(n == 1 or sum(tokens[a : a + n]) <= budget for a, n in got)
    assert all(b - (a + n) == -min(overlap, n - 1) or n <= overlap and b == a + 1 for (a, n), (b, _) in zip(got, got[1:], strict=False))


def test_contract(spark):
    rows = spark.createDataFrame([("good-name", "d", 0.9, ["p"], []), ("Bad Name", "é" * 129, 0.4, [], None)], "name string, description string, confidence double, procedures array<string>, conventions array<string>")
    got = [r.violations for r in T.contract_violations(rows).collect()]
    assert got[0] == [] and got[1] == ["description exceeds max length", "confidence below minimum threshold", "no procedures or conventions (non-actionable)", "name is not valid kebab-case"]


def test_sanitize(spark):
    rows = spark.createDataFrame([("user", "ok\x07 é"), ("System-1", "x"), ("user", "You are now"), ("user", "\x01"), ("assistant", "Disregards")], "speaker string, content string")
    assert [r.content for r in T.sanitize(rows).collect()] == ["ok "]


def test_breaker_walk(spark):
    times = [0, 1, 2, 3, 40, 41, 80]
    oks = [False, False, True, True, False, True, True]
    rows = spark.createDataFrame([("p", i, datetime.fromtimestamp(1_700_000_000 + t), ok) for i, (t, ok) in enumerate(zip(times, oks, strict=True))], "provider string, call_id bigint, at timestamp, ok boolean")
    got = [r.state for r in S.circuit_breaker(rows, 2, 30.0).orderBy("call_id").collect()]
    assert got == ["closed", "closed", "open", "open", "half_open", "open", "half_open"]


def test_renames_pair_within_a_folder(spark):
    old = spark.createDataFrame([("/a/x", "h"), ("/a/y", "h"), ("/b/z", "k"), ("/c", "m")], "path string, hash string")
    new = spark.createDataFrame([("/a/w", "h"), ("/d/z", "k"), ("/c", "n")], "path string, hash string")
    got = {(r.path, r.old_path, r.change) for r in S.snapshot_diff(old, new).collect()}
    assert got == {("/a/w", "/a/x", "renamed"), ("/a/y", None, "removed"), ("/b/z", None, "removed"), ("/d/z", None, "added"), ("/c", None, "modified")}


def test_incomplete_listing_keeps_orphans(spark):
    published = spark.createDataFrame([(1, 1, datetime(2024, 1, 1))], "point_id bigint, event_id bigint, occurred_at timestamp")
    present = spark.createDataFrame([(2,)], "point_id bigint")
    assert S.reconcile(published, present)[1].count() == 1 and S.reconcile(published, present, complete=False)[1].count() == 0


def test_backoff():
    assert S.backoff_schedule(4) == [57, 114, 171] and S.backoff_schedule(100)[-1] == 2000


def test_jaccard_join_finds_every_pair(spark):
    rng = np.random.default_rng(3)
    sets = [sorted({f"w{int(x)}" for x in rng.integers(0, 12, rng.integers(0, 9))}) for _ in range(60)] + [None]
    rows = spark.createDataFrame(list(enumerate(sets)), "skill_id bigint, w array<string>")
    for least in (0.3, 0.5, 1.0):
        want = {(i, j): round(len({*a} & {*b}) / len({*a} | {*b}), 6) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b}
        got = {(r.a, r.b): r.jaccard for r in M.jaccard_join(rows, least).collect()}
        assert got == {k: v for k, v in want.items() if v >= least} and got


def test_metrics_by_label_are_those_of_pairs(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else int(rng.integers(0, 4))) for i in range(60)], "skill_id bigint, label int")
    asked = rows.where("skill_id % 5 = 0").select(F.col("skill_id").alias("query_id"), "label").unionByName(spark.createDataFrame([(99, 77)], "query_id bigint, label int"))
    ranked = spark.createDataFrame([(q, int(s), r) for q in [*range(0, 60, 5), 99] if q != 5 for r, s in enumerate(rng.integers(0, 70, 10), 1)], "query_id bigint, skill_id bigint, rank int")
    relevant = asked.join(rows, "label").select("query_id", "skill_id")
    by_label = Q.per_query_by_label(ranked, asked, rows)
    assert sorted(by_label.collect()) == sorted(Q.per_query(ranked, relevant).collect()) and by_label.count()


def test_sub_sections_are_scored_in_blocks_without_their_texts(spark, monkeypatch):
    """Few bytes a block give the same scores; no prompt, title or content is part of a scored row."""
    queries = spark.createDataFrame([(q, f"word{q} common", [1.0, float(q)]) for q in range(5)] + [(9, None, None)], "query_id bigint, prompt string, qvec array<double>")
    parts = spark.createDataFrame([(s, 10 * s + i, f"word{i}", "common text", [float(i), 1.0]) for s in range(4) for i in range(3)], "skill_id bigint, subunit_id bigint, title string, content string, svec array<double>")
    pairs = queries.select("query_id").crossJoin(spark.range(5).withColumnRenamed("id", "skill_id"))
    whole = R.subunit_scores(pairs, parts, queries)
    assert whole.columns == ["query_id", "skill_id", "subunit_id", "semantic", "lexical", "relevance"] and whole.count() == 6 * 12
    split = R.in_blocks
    monkeypatch.setattr(R, "in_blocks", lambda *a, **b: split(*a, **b, most_bytes=2_500))
    assert sorted(R.subunit_scores(pairs, parts, queries).collect()) == sorted(whole.collect())


def test_neighbours_meet_once_and_are_not_shuffled(spark):
    """A pair that shares two communities and a tag stands once; what follows the join of pairs moves nothing."""
    skills = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["a", "b", None]), (3, None), (4, [None]), (5, ["z"])], "skill_id bigint, tags array<string>")
    links = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "y"), (9, "x"), (4, "a")], "skill_id bigint, community_id string")
    found = G.inspect_neighbourhood(skills, links, spark.createDataFrame([(1,), (4,), (5,), (1,)], "skill_id bigint"))
    got = sorted((r.asked_id, r.community, r.community_members, r.skill_id, tuple(r.shared_tags or []), r.same_community) for r in found.collect())
    assert got == [(1, "x", 3, 2, ("a", "b"), True), (1, "x", 3, 3, (), False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not plan.split("Join")[0].count("Aggregate")


def test_word_sets_meet_in_cells(spark):
    """Many small cells give what a comparison of all pairs gives; only pairs that stand leave a cell."""
    rng = np.random.default_rng(5)
    sets = [sorted({f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 30)) if x < 60}) for _ in range(150)] + [None, ["w1", "w2"], ["w1", "w2"]]
    jaccard = {(i, j): round(len({*a} & {*b}) / len({*a} | {*b}), 6) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b}
    rows = spark.createDataFrame(list(enumerate(sets)), "skill_id bigint, w array<string>")
    for least in (0.25, 0.5, 0.9):
        want = {k: v for k, v in jaccard.items() if v >= least}
        found = M.jaccard_join(rows, least, 100, 40)
        assert sorted((r.a, r.b, r.jaccard) for r in found.collect()) == sorted((*k, v) for k, v in want.items()) and want
    vectors = [None if i == 7 else [0.0, 0.0] if i == 8 else [1.0] if i == 9 else [math.cos(i), math.sin(i)] for i in range(len(sets))]
    scopes = [(None, "x", "y")[i % 3] for i in range(len(sets))]
    skills = spark.createDataFrame([(i, scopes[i], vectors[i], " ".join(w) if w else None) for i, w in enumerate(sets)], "skill_id bigint, scope string, vec array<float>, text string")
    got = {(r.a, r.b): (r.cosine, r.jaccard) for r in M.cross_scope_duplicates(skills, 0.8, 0.1, 100, 40).collect()}
    odd = {7, 8, 9}
    want = {(i, j): v for (i, j), v in jaccard.items() if v >= 0.1 and scopes[i] != scopes[j] and not {i, j} & odd and round(math.cos(i - j), 6) >= 0.8}
    assert got.keys() == want.keys() and want and all(abs(got[k][0] - math.cos(k[0] - k[1])) < 2e-6 and got[k][1] == want[k] for k in want)


def test_walks_keep_keys_apart_and_take_nulls(spark):
    rows = [(1, "a", 1, 0), (2, None, 1, 5), (3, "a", 1, 30), (4, "a", 2, 40), (5, "a", 1, 50), (6, None, 1, 64), (7, None, 1, 65), (8, "a", None, 51)]
    calls = spark.createDataFrame(rows, "call_id bigint, key string, version bigint, s bigint").withColumn("at", F.timestamp_seconds("s"))
    got = {r.call_id: r.hit for r in S.cache_hits(calls, 60).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False, 8: False}
    assert S.cache_hits(calls.where("false"), 60).count() == 0


def test_a_dense_cluster_is_a_forest(spark):
    """Equal vectors: a cell gives fewer links than rows, and all of them are one component."""
    rows = spark.range(6000).selectExpr("id AS skill_id", "array(1.0D, CASE WHEN id < 5990 THEN 0.0D ELSE 9.0D END) AS vec")
    links = G.similar_pairs(rows, 0.9, cell=1500, forest=True)
    assert links.count() < 6000 * 4
    assert {tuple(r) for r in G.recurrence_clusters(rows, 0.9).groupBy("representative").count().collect()} == {(0, 5990), (5990, 10)}


def test_refresh_carries_the_version_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    e = spark.range(40).selectExpr("id AS seq", "CASE WHEN id IN (9, 21) THEN 'graph.rebuilt' ELSE 'other' END AS event_type", "id AS version")
    got = {r.batch: (r.events, r.reloads, r.served) for r in S.coalesced_refresh(e, 2).collect()}
    assert got == {b: (2, int(b in (4, 10)), None if b < 4 else 9 if b < 10 else 21) for b in range(20)}
