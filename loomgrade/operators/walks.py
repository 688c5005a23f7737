"""Walks: rules in which what happened to a key's last row decides the next, one row at a time, in bounded memory.

Rows are dealt by key, sorted within their task, and streamed: a task holds one state, never a key's rows. A key's rows
are one task's work, as each needs the outcome of the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgrade.session import ship


def walk(rows: DataFrame, key: str, order: list[str], make: Callable[[], Callable[..., tuple]], ddl: str) -> DataFrame:
    """`rows` with new columns (ddl): make() gives a fresh rule for each key, called with every row's other values in `order`.

    The rule takes the row's columns by name and returns the new columns' values. A null key is a key.
    """
    names = rows.columns
    new = T.StructType.fromDDL(ddl).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, last, first = None, None, True
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if first or row[key] != last:
                    rule, last, first = make(), row[key], False
                made.append(rule(**row))
            columns = [pa.array([m[i] for m in made], kinds[i]) for i in range(len(new))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, names=names + new)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(ddl)]
    ship(rows.sparkSession)
    schema = T.StructType(rows.schema.fields + T.StructType.fromDDL(ddl).fields)
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
