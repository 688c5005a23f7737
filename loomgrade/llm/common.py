"""Shared pieces: word splitting, appending columns through Arrow, folder and broadcast guards.

Conventions of all operators here:
- Result columns replace input columns of the same name (compared without case); all other columns pass through.
- Helper columns start with `__lg_`; `apart` renames an input column of such a name meanwhile.
- Batches are worked on in parts of bounded text, so a worker's memory does not follow the batch.
- A null text counts as an empty one.
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrade.session import ship

#: A-Z to a-z, other ASCII but digits and letters to a space; bytes of other characters stay.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A-Z to a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(ALNUM).split()


def space_words(text: bytes | None) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D, A-Z lower-cased."""
    return (text or b"").translate(LOWER).split()


def all_space_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """`space_words` of every text in turn (binary), and how many each text has; by Arrow, without a Python object a word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends, words = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # around leading and trailing spaces
        words, ends = words.filter(pa.array(real)), np.concatenate(([0], np.cumsum(real)))[ends]
    return words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()), np.diff(ends).astype(np.int64)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER_LETTERS, LOWER_LETTERS)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


PART_BYTES = 4 << 20  # text that is worked on at once
_owner: contextvars.ContextVar[list[Broadcast] | None] = contextvars.ContextVar("owner", default=None)


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast of a value of proven size; it belongs to the `owned` block that it is made in, if any."""
    held = spark.sparkContext.broadcast(value)
    mine = _owner.get()
    if mine is not None:
        mine.append(held)
    return held


@contextlib.contextmanager
def owned() -> Iterator[None]:
    """A block that destroys the broadcasts made in it, and no others, when it ends.

    Only for blocks that write what they make: a DataFrame that is kept must not need them afterwards.
    """
    mine: list[Broadcast] = []
    token = _owner.set(mine)
    try:
        yield
    finally:
        _owner.reset(token)
        for held in mine:
            held.destroy()


def apart(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose first table may have columns of helpers' names; they bear free names while it works."""

    @functools.wraps(operator)
    def inner(df: DataFrame, *args, **kwargs) -> DataFrame:
        clash = [c for c in df.columns if c.lower().startswith("__lg_")]
        if not clash:
            return operator(df, *args, **kwargs)
        free = "kept_" + "_" * max(len(c) for c in df.columns)
        names = {c: f"{free}{i}" for i, c in enumerate(clash)}
        back = {v: k for k, v in names.items()}
        done = operator(df.withColumnsRenamed(names), *args, **kwargs)
        return done.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in done.columns])

    return inner


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` less the columns that results will replace."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def append_columns(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], ddl: str, drop: tuple[str, ...] = (), sized: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """`df` with new columns made batch by batch on the executors, without a shuffle.

    make: called once a task; what it returns maps a batch to a list of values for each new column.
    drop: input columns that the batches have but the result has not.
    sized: the string column by whose bytes batches are cut into parts; a longer value is a part by itself.
    """
    ship(df.sparkSession)
    new = T.StructType.fromDDL(ddl)
    keep = [c for c in df.columns if c not in drop]
    schema = T.StructType([df.schema[c] for c in keep] + new.fields)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    names = keep + new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for a, b in row_parts(whole.num_rows, byte_sizes(whole.column(sized)), part_bytes):
                batch = whole.slice(a, b - a)
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(work(batch), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=names)

    return df.mapInArrow(run, schema)


def byte_sizes(column: pa.Array) -> list[int]:
    return [n or 0 for n in pc.binary_length(column).to_pylist()]


def row_parts(n: int, sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut n rows into runs of at most `most` in total size, one row at least."""
    start, total = 0, 0
    for i in range(n):
        if i > start and total + sizes[i] > most:
            yield start, i
            start, total = i, 0
        total += sizes[i]
    if n > start:
        yield start, n


def bounded_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """About `most` rows at most, those of the least hashes of their keys; all rows if there are no more.

    A filter, not a sort: a limit would send that many rows of each partition to the driver.
    """
    n = df.count()
    if n <= most:
        return df
    share = int((1 << 40) * 0.97 * most / n)
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < share)
