"""Vector functions in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DIMENSIONS = 32_768


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def valid_vector(v: Column) -> Column:
    """Finite and of 1 to 32,768 dimensions."""
    finite = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(v) > 0) & (F.size(v) <= MOST_DIMENSIONS), F.lit(False))


def result_score(x: Column) -> Column:
    """six decimals."""
    return F.round(x, 6)
