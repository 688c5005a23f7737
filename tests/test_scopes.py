"""Scope resolution and stances on their own cases."""

import pytest
from pyspark.sql import functions as F

from loomgrade.operators import scopes as S
from loomgrade.operators import stance as A


def strings(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_paths(spark):
    for path, plain in (("/a//b/./c/../d/", "/a/b/d"), ("/../a", "/a"), ("/", "/"), ("a/../../b", "b"), ("", "")):
        assert value(spark, S.plain_path(F.lit(path))) == plain
    assert value(spark, S.ancestors(F.lit("/a/b"))) == ["/a/b", "/a", "/"] and value(spark, S.ancestors(F.lit("a/b"))) == ["a/b", "a"] and value(spark, S.ancestors(F.lit(""))) == []


@pytest.mark.parametrize("hot", [100_000, 2])
def test_projects(spark, hot):
    marked = spark.createDataFrame([("/w/repo",), ("/w/repo/",), ("/w/repo/sub",), (None,)], "root string")
    rows = [(1, "/w/repo/sub/x"), (2, "/w/repo/subx"), (3, "/w/repo"), (4, "/w/repository"), (5, None), (6, "/w/repo/sub/../y"), (7, "/w/repo/sub/x")]
    asked = spark.createDataFrame(rows, "id bigint, repo_path string")
    got = lambda **k: {r.id: (r.project_root, r.resolver, r.degraded) for r in S.resolve_projects(asked, marked, hot=hot, **k).collect()}
    sub, repo = ("/w/repo/sub", "marker", None), ("/w/repo", "marker", None)
    assert got() == {1: sub, 2: repo, 3: repo, 4: (None, None, "no_marker_above_path"), 5: (None, None, "no_marker_above_start"), 6: repo, 7: sub}
    assert got(start="/w/repo/z")[5] == repo
    declared = got(configured=" /mnt ", start="/w/repo")
    assert declared[1] == sub and declared[4] == declared[5] == ("/mnt", "configured", None)
    missing = got(configured="/mnt", exists=False)
    assert missing[1] == sub and missing[4] == missing[5] == (None, None, "configured_root_missing")


def test_global_scopes(spark):
    case = lambda paths, roots: tuple(value(spark, S.global_scope(paths, roots)))
    assert case(strings("/g/a/", " "), strings("/g")) == (["/g/a"], None)
    assert case(strings("/g/../h"), strings("/g")) == (None, "path_outside_roots") and case(strings("/gx"), strings("/g")) == (None, "path_outside_roots")
    assert case(strings("g"), strings("/g")) == (None, "path_not_absolute") and case(strings("/g"), strings("g")) == (None, "allowed_root_not_absolute")
    assert case(strings(), strings("/g")) == (None, "no_paths") and case(strings("/g"), strings(" ")) == (None, "no_allowed_roots") and case(strings("/g"), strings("/")) == (["/g"], None)


def test_a_scope_has_a_type_an_id_and_paths(spark):
    case = lambda t, i, own, paths: value(spark, S.in_scope(F.lit(t), F.lit(i), own, F.lit("project"), F.lit("p1"), paths))
    assert case("project", "p1", strings("/a/x"), strings("/a")) and case("project", "p1", strings(), strings())
    assert not case("project", "p2", strings("/a/x"), strings("/a")) and not case("global", "p1", strings("/a/x"), strings("/a"))
    assert not case("project", "p1", strings("/a/x", "/b"), strings("/a")) and not case("project", "p1", strings(), strings("/a"))


def test_stances(spark):
    far = "x " * 70
    cases = {
        "Never run rm -rf on it": "warns_against",
        "To clean up, run RM -RF now": "recommends",
        "the command rm -rf exists": "neutral_mention",
        "nothing here": "absent",
        f"avoid it {far} rm -rf {far} run": "neutral_mention",  # cues beyond the window
        f"never rm -rf {far} just run rm -rf": "recommends",  # the worst of two hits
        "é" * 59 + "never rm -rf": "warns_against",
        "never" + "é" * 58 + "rm -rf": "warns_against",  # 5 + 116 bytes: the window cuts into the cue only at 121
        "never " + "é" * 58 + "rm -rf": "neutral_mention",
        "use rm -rfrm -rf": "recommends",
    }
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "text string").select("text", A.stance(F.col("text"), "rm -rf").alias("s")).collect()
    got = {r.text: r.s for r in rows}
    want = {**cases, None: "absent", "never" + "é" * 58 + "rm -rf": "neutral_mention"}  # `never` loses its first byte
    assert got == want
    assert value(spark, A.is_safe(F.lit("warns_against"))) and not value(spark, A.is_safe(F.lit("recommends")))
    assert value(spark, A.stance(F.lit("run a\\E.b"), "a\\E.b")) == "recommends" and value(spark, A.stance(F.lit("run axb"), "a.b")) == "absent"
    with pytest.raises(ValueError, match="token"):
        A.stance(F.lit("x"), "")
