"""Vector and score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, in [-1, 1]; 0 for nulls or unequal sizes, and a zero norm counts as 1e-9."""
    scale = F.greatest(norm(a), F.lit(1e-9)) * F.greatest(norm(b), F.lit(1e-9))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(value)


def biased(score: Column, bias: Column) -> Column:
    """Score plus bias (null: none), kept in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + F.coalesce(bias, F.lit(0.0))))


def normalised_search_score(score: Column) -> Column:
    """Full-text scores on a scale of 0 to 1: missing is 0.5, and over 1 a tenth, 1 at most."""
    return F.when(score.isNull(), 0.5).when(score > 1, F.least(score / 10, F.lit(1.0))).otherwise(score)


def blend(semantic: Column, probability: Column, weight: float = 0.4) -> Column:
    return weight * semantic + (1 - weight) * probability
