"""Expressions on vectors and lists of scores; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one of them is empty or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_vector(vectors: Column, size: int) -> Column:
    """Mean of an array of vectors."""
    zero = F.array_repeat(F.lit(0.0), size)
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: F.try_divide(x, F.size(vectors).cast("double")))


def mean_known(*scores: Column) -> Column:
    """Mean of the scores that are not null; null if none is (A2)."""
    kept = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), F.size(kept).cast("double"))


def lowest_mean(scores: Column, n: int) -> Column:
    """Mean of the ``n`` lowest scores."""
    return F.aggregate(F.slice(F.array_sort(scores), 1, n), F.lit(0.0), lambda s, x: s + x) / n


def highest_mean(scores: Column, n: int) -> Column:
    """Mean of the ``n`` highest scores."""
    return F.aggregate(F.slice(F.sort_array(scores, asc=False), 1, n), F.lit(0.0), lambda s, x: s + x) / n


def mean_nonzero(scores: Column) -> Column:
    """Mean of the scores that are not zero; 0 if none is."""
    kept = F.filter(scores, lambda x: x != 0)
    return F.coalesce(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), F.size(kept).cast("double")), F.lit(0.0))


def closeness(difference: Column, largest: Column) -> Column:
    """``1 - difference / largest``; null where the largest difference is 0."""
    return 1.0 - F.try_divide(difference.cast("double"), largest.cast("double"))


def blended(semantic: Column, sequence: Column, weight: float = 0.8, decisive: float = 0.8) -> Column:
    """Sequence similarity if it is decisive, else the weighted mean of both."""
    return F.when(sequence >= decisive, sequence).otherwise(weight * semantic + (1 - weight) * sequence)
