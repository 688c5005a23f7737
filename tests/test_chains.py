"""Chains of stored events over segments and tasks against the rule walked row by row."""

import random

import pytest

from loomgrade.operators import chains


def plain(rows, ttl):
    """fresh by (key, id): the rule as it is said, one event at a time."""
    out, stored = {}, {}
    for key, t, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        last = stored.get(key)
        hit = last is not None and v is not None and last[1] == v and t - last[0] < ttl
        out[key, i] = not hit
        if not hit:
            stored[key] = (t, v)
    return out


@pytest.mark.parametrize(("segment", "ttl", "versions"), [(10_000, 50, 1), (7, 50, 1), (7, 3, 3), (3, 0, 2), (5, 10_000, 2), (64, 400, 4)])
def test_chains_equal_the_rule(spark, segment, ttl, versions):
    rnd = random.Random(segment * 31 + ttl)
    rows = [("hot", rnd.randrange(3000), i, rnd.randrange(versions) if rnd.random() < 0.95 else None) for i in range(400)]
    rows += [(rnd.choice([None, "a", "b", "c"]), rnd.randrange(500), 1000 + i, i // 20 % versions) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, t bigint, i bigint, v bigint").repartition(6)
    got = {(r.key, r.i): r.fresh for r in chains.fresh(df, "key", "t", "i", "v", ttl, segment).collect()}
    assert got == plain(rows, ttl)


def test_a_hot_key_is_spread_over_tasks(spark):
    """A million events of one key: in several tasks, equal to a closed form; and an empty table."""
    rows = spark.range(1_000_000).selectExpr("'k' AS key", "id AS t", "id AS i")
    made = chains.fresh(rows, "key", "t", "i", None, 1000)
    assert made.where("fresh <> (i % 1000 = 0)").count() == 0 and made.count() == 1_000_000
    assert made.rdd.getNumPartitions() > 1
    assert chains.fresh(rows.where("false"), "key", "t", "i", None, 1000).count() == 0
