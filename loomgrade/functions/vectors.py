"""Cosine in its variants, as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """0 for vectors of different or no length, or of norm zero. Norms may be given, to be computed once a row."""
    na, nb = norm(a) if na is None else na, norm(b) if nb is None else nb
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def strict_cosine(a: Column, b: Column) -> Column:
    """An error for vectors of different length or of norm zero."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).when((norm(a) == 0) | (norm(b) == 0), F.raise_error(F.lit("a vector has norm zero")).cast("double")).otherwise(dot(a, b) / (norm(a) * norm(b)))


def hashing_embedding(tokens: Column, size: int = 768) -> Column:
    """Unit vector of token counts in hashed buckets; the default embedder. No tokens give a zero vector."""
    buckets = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    length = norm(raw)
    return F.transform(raw, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)).cast("float"))
