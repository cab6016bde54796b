"""Vector expressions over ARRAY<FLOAT>, summed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; a zero vector is at distance 1 of all."""
    n = norm(a) * norm(b)
    return 1.0 - F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def distance_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - distance)
