"""Chains: rules in which a key's last stored event decides which later one is stored next, for keys of any size.

An event is stored if the last stored one is too old or of another version; what is stored in turn decides. Rows are sorted by
ranges of (key, time, id), not dealt by key, and cut into segments. Within a segment each event has a successor, the
one that would be stored next, by a range search and the next change of version; pointer doubling gives the last event
of the segment that is stored if the chain enters at it. So a segment is a step function from the state before it to
the state after it, a few numbers where chains meet, as they soon do. Only keys of several segments walk over those
steps, a row a segment; then every segment marks its own rows. A hot key is spread over tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgrade.operators.walks import walk
from loomgrade.session import materialise, ship

END = (1 << 63) - 1


def _changes(v: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where a version differs from the one before it; an unknown one differs from all."""
    return (v[1:] != v[:-1]) | ~known[1:] | ~known[:-1]


def successors(t: np.ndarray, v: np.ndarray, known: np.ndarray, ttl: int) -> np.ndarray:
    """For each event the one that is stored next if it is stored; the number of events if none is."""
    n = len(t)
    turn = np.append(np.flatnonzero(_changes(v, known)) + 1, n)
    change = turn[np.searchsorted(turn, np.arange(n), side="right")]
    late = np.searchsorted(t, t + ttl, side="left")
    return np.minimum(change, np.maximum(late, np.arange(n) + 1))


def lasts(successor: np.ndarray) -> np.ndarray:
    """The last event that is stored if each one is, by pointer doubling."""
    last = np.where(successor < len(successor), successor, np.arange(len(successor)))
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def _steps(t: np.ndarray, v: np.ndarray, known: np.ndarray, ttl: int) -> tuple:
    """(leading version, cuts, times, versions): from what time on the chain enters, and the last stored event's time and version then."""
    last = lasts(successors(t, v, known, ttl))
    lead = int(np.argmax(_changes(v, known))) + 1 if len(t) > 1 and _changes(v, known).any() else len(t)
    entries, cuts = list(range(lead)), t[:lead].tolist()
    if lead < len(t):
        entries.append(lead)
        cuts.append(END)
    ends = last[entries]
    keep = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))  # of equal ends the latest entry
    at = ends[keep]
    return (int(v[0]) if known[0] else None, [cuts[i] for i in keep], t[at].tolist(), [int(x) if k else None for x, k in zip(v[at], known[at], strict=True)])


class _Walk:
    """The state before each segment of a key."""

    def __init__(self):
        self.t = self.v = None

    def __call__(self, lead, cuts, times, versions, ttl, **_) -> tuple:
        before = self.t, self.v
        at = 0 if self.t is None or lead is None or self.v != lead else bisect_left(cuts, self.t + ttl)
        if at < len(cuts):
            self.t, self.v = times[at], versions[at]
        return before


def fresh(rows: DataFrame, key: str, time: str, order: str, version: str | None, ttl: int, segment: int = 10_000) -> DataFrame:
    """key, order, fresh: whether an event is stored, that is no hit of the last stored one of its key.

    rows: key and order of any sortable types, time (bigint), version (bigint, or None for none). A stored event is hit by later ones of
    its version for less than `ttl`; a null version hits nothing. Events go by time, then order. A null key is a key; null times are left out. segment: rows that
    are searched together, at most.
    """
    ship(rows.sparkSession)
    kinds = [rows.schema[c].dataType for c in (key, order)]
    plain = rows.where(F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("id"), F.col(time).alias("t"), (F.col(version) if version else F.lit(0)).cast("bigint").alias("v"))
    by = [F.asc_nulls_first("key"), F.asc("t"), F.asc_nulls_first("id")]
    ranged = plain.repartitionByRange(*by).sortWithinPartitions(*by)
    ddl = f"key {kinds[0].simpleString()}, seg bigint, id array<{kinds[1].simpleString()}>, t array<bigint>, v array<bigint>, lead bigint, cuts array<bigint>, times array<bigint>, versions array<bigint>"

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = batch.column("v")
        return batch.column("t").to_numpy(), v.fill_null(0).to_numpy(zero_copy_only=False), v.is_valid().to_numpy(zero_copy_only=False)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for start in range(0, whole.num_rows, segment):
                batch = whole.slice(start, segment)
                t, v, known = columns(batch)
                code = batch.column("key").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                edges = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)]
                offsets = pa.array(edges, pa.int32())
                made = [_steps(t[a:b], v[a:b], known[a:b], ttl) for a, b in zip(edges, edges[1:], strict=False)]
                lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("id", "t", "v")]
                steps = [pa.array([m[0] for m in made], pa.int64()), *(pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (1, 2, 3))]
                own = [batch.column("key").take(pa.array(edges[:-1])), pa.array(range(number, number + len(made)), pa.int64()), *lists, *steps]
                number += len(made)
                yield pa.RecordBatch.from_arrays(own, names=["key", "seg", "id", "t", "v", "lead", "cuts", "times", "versions"])

    segs = materialise(ranged.mapInArrow(cut, ddl), "chains")
    several = segs.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k")
    steps = segs.join(several, F.col("key").eqNullSafe(F.col("k")), "left_semi").select("key", "seg", "lead", "cuts", "times", "versions", F.lit(ttl).cast("bigint").alias("ttl"))
    before = walk(steps, "key", ["seg"], _Walk, "t0 bigint, v0 bigint").select("seg", "t0", "v0")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                inner = pa.RecordBatch.from_arrays([one.column(c).flatten() for c in ("id", "t", "v")], names=["id", "t", "v"])
                t, v, known = columns(inner)
                t0, v0 = one.column("t0")[0].as_py(), one.column("v0")[0].as_py()
                n = len(t)
                at = 0
                if t0 is not None and known[0] and v0 == v[0]:
                    turn = np.flatnonzero(_changes(v, known))
                    at = min(int(np.searchsorted(t, t0 + ttl, side="left")), int(turn[0]) + 1 if len(turn) else n)
                next_, new = successors(t, v, known, ttl).tolist(), np.zeros(n, bool)
                while at < n:
                    new[at] = True
                    at = next_[at]
                yield pa.RecordBatch.from_arrays([pa.repeat(one.column("key")[0], n).cast(to_arrow_type(kinds[0])), inner.column("id"), pa.array(new)], names=["key", "id", "fresh"])

    out = f"key {kinds[0].simpleString()}, id {kinds[1].simpleString()}, fresh boolean"
    done = segs.select("key", "seg", "id", "t", "v").join(before, "seg", "left").mapInArrow(mark, out)
    return done.select(F.col("key").alias(key), F.col("id").alias(order), "fresh")
