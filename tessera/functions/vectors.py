"""Distances between vectors (arrays of numbers), in float64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(x) -> Column:
    """A Column of numbers, or a list of numbers and scalar expressions in which null counts as 0."""
    if isinstance(x, Column):
        return x.cast("array<double>")
    return F.array(*(F.coalesce(v, F.lit(0.0)).cast("double") if isinstance(v, Column) else F.lit(float(v or 0)) for v in x))


def _sum(a, b, of) -> Column:
    a, b = vector(a), vector(b)
    total = F.aggregate(F.zip_with(a, b, of), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)  # of unequal lengths: null


def inner_product(a, b) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def negative_inner_product(a, b) -> Column:
    return -inner_product(a, b)


def distance(a, b) -> Column:
    """The Euclidean distance."""
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def rectilinear_distance(a, b) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def cosine_distance(a, b) -> Column:
    """1 minus the cosine; null if either has length zero."""
    return 1 - F.try_divide(inner_product(a, b), F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b)))


DISTANCES = {"$distance": distance, "$innerProduct": inner_product, "$negInnerProduct": negative_inner_product, "$cosineDistance": cosine_distance, "$rectilinearDistance": rectilinear_distance}
