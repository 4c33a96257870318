"""Expressions over dense vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Sum of the products, in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vectors; 0 when one of them is the zero vector."""
    size = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(size > 0, dot(left, right) / size).otherwise(0.0)


def unit(vector: Column) -> Column:
    """Vector of length 1 (or the zero vector), in double precision."""
    size = F.sqrt(dot(vector, vector))
    return F.when(
        size > 0, F.transform(vector, lambda value: value.cast("double") / size)
    ).otherwise(vector.cast("array<double>"))
