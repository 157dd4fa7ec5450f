"""Vector arithmetic on array columns, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANK_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector is similar to nothing."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def row_error(x: Column, y: Column) -> Column:
    """Mean squared error of one reconstructed row."""
    squared = F.zip_with(x, y, lambda p, q: (p - q) * (p - q))
    return F.aggregate(squared, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)


def rank_key(sim: Column) -> Column:
    """Scores are ranked on 9 digits so the order does not hang on summation order."""
    return F.round(sim, RANK_DIGITS)
