"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero (F-COS)."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    """The unit vector; a zero vector stays (F-L2N)."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def size_factor(n: Column, pivot: int = 20, steepness: float = 0.5) -> Column:
    """Grows as a sigmoid up to the pivot and as a softplus beyond (F-SIZE)."""
    late = F.log1p(F.exp(steepness * (n - pivot))) / F.log(F.lit(2.0))
    return F.when(n <= pivot, 1 / (1 + F.exp(-n))).otherwise(late)
