"""Every query by name, with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgrade.plans import graph, maintenance, retrieval, scopes, service, state, transcripts

GROUPS = (retrieval, graph, maintenance, transcripts, state, service, scopes)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fused_topn(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made[0] for group in GROUPS for name, made in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: made[1] for group in GROUPS for name, made in group.QUERIES.items() if made[1]}
