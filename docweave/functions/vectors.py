"""Dense vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for a null vector or vectors of different length."""
    fit = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    return F.when(fit, total(F.zip_with(a, b, lambda x, y: x * y))).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def normalized(v: Column) -> Column:
    """The vector divided by its Euclidean norm; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
