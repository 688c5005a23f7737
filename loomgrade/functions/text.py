"""Tokenizers, overlaps and string shapes as column expressions. All are built-in functions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrade.functions.fixed import STOP_WORDS

_NOT_ALNUM = r"[^\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """Distinct lower-cased runs of letters and digits (T1)."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), _NOT_ALNUM), lambda x: x != ""))


def label_words(c: Column) -> Column:
    """Runs of letters and digits of three bytes or more, repeats included, without numbers and stop words (T2)."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    raw = F.filter(F.split(F.coalesce(c, F.lit("")), _NOT_ALNUM), lambda x: F.octet_length(x) >= 3)
    low = F.transform(raw, ascii_lower)
    return F.filter(low, lambda x: ~x.rlike("^[0-9]+$") & ~F.array_contains(stop, x))


def blank_words(c: Column) -> Column:
    """Distinct runs between white space, case kept (T3)."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def content_words(c: Column) -> Column:
    """T1 without stop words (T4)."""
    return F.array_except(words(c), F.array(*[F.lit(w) for w in STOP_WORDS]))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def overlap(left: Column, right: Column) -> Column:
    """Share of the left set that the right set has; 0 if either is empty."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / F.size(left))


def jaccard(left: Column, right: Column) -> Column:
    """Null if either set is empty."""
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)))


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(c, F.lit(p))
    return hit


def sentences(c: Column) -> Column:
    """Cut after a full stop, exclamation or question mark or line feed; blank ones dropped, the rest untrimmed."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?\n])"), lambda x: F.trim(x) != "")


def slugify(c: Column, fallback: str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(ascii_lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit(fallback)).otherwise(slug)


def token_estimate(c: Column) -> Column:
    """A quarter of the bytes, one at least."""
    return F.greatest(F.floor(F.octet_length(F.coalesce(c, F.lit(""))) / 4), F.lit(1)).cast("bigint")


def three_places(x: Column) -> Column:
    """A number with three decimal places as C writes it: by its exact binary value, halves to even.

    format_string rounds the shortest decimal that names the number, halves up. The decimal format takes 0.0005, which lies above the half, down.
    """
    return F.when(x == 0.0005, "0.001").otherwise(F.call_function("format_number", x, F.lit("0.000")))


def stable_id(kind: str, key: Column) -> Column:
    """A name-based id in the shape of a random UUID: the first 128 bits of a SHA-256 of kind and key, with version and variant set."""
    h = F.sha2(F.concat(F.lit(f"{kind}:"), key), 256)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    parts = F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    return F.concat_ws("-", *parts)
