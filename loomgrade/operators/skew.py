"""Joins whose left side may hold a third of its rows in one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrade.session import materialise

HOT = 100_000  # rows of a key from which on it is hot
MOST_HOT = 100_000  # hot keys that are broadcast, at most: the bound of what leaves the shuffle


def lookup(rows: DataFrame, key: str, by: DataFrame, hot: int = HOT, how: str = "inner") -> DataFrame:
    """`rows` joined to `by`, which has each key once: rows of hot keys where they stand, all others by a shuffle.

    A key is hot from `hot` rows on, or more if that leaves more than MOST_HOT keys, so the broadcast is bounded: by
    rows / hot and by MOST_HOT. A null key meets nothing. how: inner or left.
    """
    counts = materialise(rows.groupBy(key).count().where(F.col("count") >= hot).where(F.col(key).isNotNull()), "hot")
    found = counts.count()
    if not found:
        return rows.join(by, key, how)
    if found > MOST_HOT:
        least = counts.approxQuantile("count", [1 - MOST_HOT / found / 2], 0.001)[0]
        counts = counts.where(F.col("count") > least)
    keys = F.broadcast(counts.select(key))
    many = F.broadcast(by.join(keys, key, "left_semi"))
    cold = rows.join(keys, key, "left_anti").join(by, key, how)
    return rows.join(keys, key, "left_semi").join(many, key, how).unionByName(cold)
