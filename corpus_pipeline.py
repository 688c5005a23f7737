"""A corpus pipeline of five operators: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All stages but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrade.llm import bpe, decontamination, line_dedup, simhash, toxicity
from loomgrade.llm.common import owned
from loomgrade.session import materialise, ship, table


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _guarded(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`stage` applied to docs, whose other columns bear plain names meanwhile, so that none can clash with its results."""
    others = [c for c in docs.columns if c not in OWN]
    plain = docs.select(*[c for c in docs.columns if c in OWN], *[F.col(f"`{c}`").alias(f"extra_{i}") for i, c in enumerate(others)])
    done = stage(plain)
    return done.select(*[F.col(f"extra_{others.index(c)}").alias(c) if c in others else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return _guarded(docs, lambda d: toxicity.drop_toxic(d, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier line equals or nearly equals; n_chars follows."""
    ship(spark)
    return _guarded(docs, line_dedup.dedup_lines)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the least doc_id."""
    ship(spark)
    return _guarded(docs, simhash.deduplicate)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in passages of test items."""
    ship(spark)
    items = table(spark, sf_dir, "benchmark")
    return _guarded(docs, lambda d: decontamination.decontaminate(d, items, action="drop"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    import public_tokenizers

    ship(spark)
    encoded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("byte_bpe_50k.json"), check=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Toxicity, fingerprints and BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with owned():  # what the stage broadcasts is of no use once its documents are written
            docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
