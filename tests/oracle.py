"""Runs a query beside its SQL in DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir, query, sql):
    """Asserts equal names and rows, and at least one row; returns the number of rows."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    found = duck(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    theirs = rows(names, found.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    diff = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b]
    assert len(mine) == len(theirs) and not diff, f"{len(mine)} rows, SQL {len(theirs)}; {diff[:3]}"
    assert mine, "no rows"
    return len(mine)
