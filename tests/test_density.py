"""Density clustering in cells against a plain version: all pairs sorted, merged one by one, trees of lists."""

import re
from collections import defaultdict

import numpy as np
import pytest

from loomgrade.operators import density as D
from loomgrade.operators import graph as G
from loomgrade.plans import bindings as B
from loomgrade.plans import graph as P


def plain_clusters(x, least):
    """Clusters of rows, numbered by their first rows: the published steps with whole matrices and lists of members."""
    n = len(x)
    if n < least:
        return [-1] * n
    far = np.array([np.sqrt(((x - row) ** 2).sum(axis=1)) for row in x])
    core = np.sort(far, axis=1)[:, least - 1]
    reach = np.maximum(far, np.maximum(core[:, None], core[None, :]))
    group = {i: [i] for i in range(n)}
    tree = {i: i for i in range(n)}  # a group's node: a row, or (distance, node, node)
    of = list(range(n))
    for w, a, b in sorted((reach[a, b], a, b) for a in range(n) for b in range(a + 1, n)):
        p, q = of[a], of[b]
        if p == q:
            continue
        tree[p] = (w, tree[p], tree[q])
        for i in group[q]:
            of[i] = p
        group[p] += group.pop(q)
    rows = lambda t: [t] if isinstance(t, int) else rows(t[1]) + rows(t[2])

    def condense(t, born):
        """(stability, members that leave it, children) of the cluster that begins with node t."""
        gone, total = [], 0.0
        while True:
            if isinstance(t, int):
                return total + 1e12 - born, [*gone, t], []
            dense = min(1 / t[0], 1e12) if t[0] > 0 else 1e12
            sides = [(len(rows(s)), s) for s in t[1:]]
            if min(k for k, _ in sides) >= least:
                return total + (dense - born) * sum(k for k, _ in sides), gone, [condense(s, dense) for _, s in sides]
            for k, s in sides:
                if k < least:
                    gone += rows(s)
                    total += (dense - born) * k
            large = [s for k, s in sides if k >= least]
            if not large:
                return total, gone, []
            t = large[0]

    everyone = lambda c: c[1] + [r for k in c[2] for r in everyone(k)]

    def choose(c, root):
        below = [choose(k, False) for k in c[2]]
        inner = sum(s for s, _ in below)
        if root or (c[2] and inner > c[0]):
            return inner, [m for _, ms in below for m in ms]
        return c[0], [everyone(c)]

    out = [-1] * n
    for k, members in enumerate(sorted(choose(condense(tree[of[0]], 0.0), True)[1], key=min)):
        for i in members:
            out[i] = k
    return out


def whole(x, least):
    core = np.array([np.partition(D._far(x, row), least - 1)[least - 1] for row in x])
    a, b, w = D._forest(x, core, np.arange(len(x)), None)
    return D.tree_clusters(len(x), np.minimum(a, b), np.maximum(a, b), w, least).tolist()


def test_flat_trees_equal_plain_ones():
    rng = np.random.default_rng(4)
    for case in range(30):
        n, least = int(rng.integers(8, 70)), int(rng.integers(2, 7))
        x = np.concatenate([rng.normal(rng.normal(0, 3, 2), rng.uniform(0.05, 1), (n // 2, 2)) for _ in range(2)] + [rng.uniform(-9, 9, (n // 3, 2))])
        if case % 3 == 0:
            x = np.round(x)  # equal rows and equal distances
        assert whole(x, least) == plain_clusters(x, least), case


@pytest.mark.parametrize(("cell", "finish"), [(2000, 1_000_000), (40, 0)])
def test_cells_and_rounds_equal_the_plain_version(spark, cell, finish):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(rng.normal(0, 3, 3), rng.uniform(0.05, 0.8), (40, 3)) for _ in range(5)] + [rng.uniform(-9, 9, (40, 3))])
    rows = [("a" if i % 3 else None, i, v) for i, v in enumerate(x.tolist())] + [("tiny", 9000 + i, [1.0]) for i in range(2)]
    got = {r.skill_id: r for r in D.density_clusters(spark.createDataFrame(rows, "scope string, skill_id bigint, vec array<double>"), 4, cell, finish).collect()}
    assert len(got) == len(rows) and got[9000].cluster == got[9001].cluster == -1 and got[0].scope is None
    for own in ([i for i in range(len(x)) if i % 3], [i for i in range(len(x)) if not i % 3]):
        assert [got[i].cluster for i in own] == plain_clusters(x[own], 4)
    assert len({r.cluster for r in got.values()}) > 3


def test_tight_groups_are_searched_and_lists_grow_with_the_rows_alone(spark):
    """Groups larger than a row's list, of copies and of rows on a grid, far apart: no list leaves its group, and many distances are equal."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.tile([50.0, 0.0, 1.0], (30, 1)), *[rng.integers(0, 3, (30, 3)) + 20.0 * c for c in range(4)], rng.normal(0, 0.1, (35, 3)) - 40, rng.uniform(-90, 90, (20, 3))])
    x = x[rng.permutation(len(x))]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(x.tolist())] + [("a", 500 + i, [float("nan"), 1.0, bad]) for i, bad in enumerate((0.0, float("inf")))], "scope string, skill_id bigint, vec array<double>")
    for cell, finish in ((2000, 1_000_000), (25, 0)):
        got = {r.skill_id: r.cluster for r in D.density_clusters(rows, 3, cell, finish).collect()}
        assert [got[i] for i in range(len(x))] == plain_clusters(x, 3) and got[500] == got[501] == -1, cell
    sizes = []
    for blocks in (2, 8):  # pairs that are kept do not follow the number of cells
        dealt = rows.where("skill_id < 500").selectExpr("scope", "skill_id AS id", "vec AS v", f"CAST(skill_id % {blocks} AS INT) AS at", f"{blocks} AS blocks")
        sizes.append(D._listed_edges(D._nearest(dealt, 3, 2)).count())
    assert sizes[0] == sizes[1] <= (2 + D.MORE) * len(x)


def test_odd_vectors(spark):
    rows = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [1.0, 2.0]), ("a", 3, [1.0])], "scope string, skill_id bigint, vec array<double>")
    with pytest.raises(ValueError, match="lengths"):
        D.density_clusters(rows)
    assert D.density_clusters(rows.where("false")).count() == 0
    same = rows.where("size(vec) = 1").union(rows.where("skill_id = 1").selectExpr("scope", "7L", "vec"))
    assert {r.cluster for r in D.density_clusters(same).collect()} == {-1}  # one dense group is the root, which is never chosen


def test_communities_of_both_layers(spark):
    """The rebuild's memberships: clusters by the plain version, named by terms of their own texts, noise set apart."""
    sf = "/root/testdata/sf0.001"
    skills = B.skills(spark, sf).collect()
    got = defaultdict(dict)
    for r in P.graph_communities(spark, sf).collect():
        assert r.skill_id not in got[r.source]
        got[r.source][r.skill_id] = r.name
    assert all(got["tag"][s.skill_id] == f"{s.scope}-{s.tags[0]}" for s in skills)
    for scope in ("project", "global"):
        own = sorted((s for s in skills if s.scope == scope), key=lambda s: s.skill_id)
        names = defaultdict(set)
        for s, c in zip(own, plain_clusters(np.array([s.vec for s in own], float), D.LEAST_CLUSTER), strict=True):
            names[c].add(got["hdbscan"][s.skill_id])
        assert all(len(v) == 1 for v in names.values()) and names.pop(-1, {f"{scope}-unclustered"}) == {f"{scope}-unclustered"}
        assert len({next(iter(v)) for v in names.values()}) == len(names)
        for c, v in names.items():
            assert re.fullmatch(rf"{scope}-cluster-.+", next(iter(v))), c


def test_labels_prefer_a_clusters_own_terms(spark):
    texts = {1: "this skill does retrieval retrieval over vectors", 2: "this skill does retrieval retrieval", 3: "this skill does scoring scoring of ranks", 4: "this skill does scoring scoring", 5: "this skill is something else"}
    skills = spark.createDataFrame([(i, "project", t, ["X"]) for i, t in texts.items()], "skill_id bigint, scope string, text string, tags array<string>")
    clusters = spark.createDataFrame([("project", 1, 0), ("project", 2, 0), ("project", 3, 1), ("project", 4, 1), ("project", 5, -1)], "scope string, skill_id bigint, cluster bigint")
    got = {(r.skill_id, r.source): r.name for r in G.communities(clusters, skills).collect()}
    assert got[1, "hdbscan"] == got[2, "hdbscan"] != got[3, "hdbscan"] == got[4, "hdbscan"] and got[5, "hdbscan"] == "project-unclustered"
    assert "retrieval" in got[1, "hdbscan"] and "scoring" in got[3, "hdbscan"] and "skill" not in got[1, "hdbscan"].split("-")[2:] and got[5, "tag"] == "project-x"
