"""Vector arithmetic on array columns, in double precision and a fixed order of summation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` over its length; the zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def hamming_similarity(a: Column, b: Column) -> Column:
    """Percent of equal bits of two 64-bit hashes."""
    return F.lit(100) - F.floor(F.bit_count(a.bitwiseXOR(b)) * 100 / 64)


def quantised(score: Column) -> Column:
    return F.round(score * 1e6) / 1e6
