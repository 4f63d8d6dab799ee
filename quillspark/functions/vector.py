"""Vector functions over array columns, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero; null if either is null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def cosine_raw(a: Column, b: Column) -> Column:
    """Null for zero vectors."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: hashed bag of words, normalised."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    n = norm(raw)
    return F.transform(raw, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))
