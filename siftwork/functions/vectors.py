"""Vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Between 0 and 1; 0 where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / lengths))).otherwise(0.0)


def joined_unit(a: Column, b: Column) -> Column:
    """Both vectors behind each other, of length 1."""
    both = F.transform(F.concat(a, b), lambda x: x.cast("double"))
    length = norm(both)
    return F.when(length > 0, F.transform(both, lambda x: x / length)).otherwise(both)


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))
