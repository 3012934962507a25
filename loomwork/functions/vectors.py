"""Distances between vector columns; smaller is nearer for all of them.

Arrays are widened to DOUBLE. Vectors of different lengths raise an error, as
does an unknown metric; a NULL vector gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "cosine", "dot")
DEFAULT_METRIC = "cosine"


def vector(values) -> Column:
    """A column from a column, its name, or a sequence of numbers."""
    if isinstance(values, Column):
        return values.cast("array<double>")
    if isinstance(values, str):
        return F.col(values).cast("array<double>")
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector dimension mismatch")).cast("double")).when(a.isNotNull() & b.isNotNull(), value)


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, x: acc + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def squared_euclidean(a, b) -> Column:
    a, b = vector(a), vector(b)
    return _checked(a, b, _sum(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a, b) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def cosine(a, b) -> Column:
    """1 - cosine similarity; 1 where a vector has no length."""
    a, b = vector(a), vector(b)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return _checked(a, b, F.when(norms == 0, F.lit(1.0)).otherwise(1.0 - _dot(a, b) / norms))


def negated_dot(a, b) -> Column:
    a, b = vector(a), vector(b)
    return _checked(a, b, -_dot(a, b))


def distance(metric: str = DEFAULT_METRIC):
    """The column function of a metric's name."""
    found = {"euclidean": euclidean, "cosine": cosine, "dot": negated_dot}.get(metric)
    if found is None:
        raise ValueError(f"unknown metric {metric!r}; there are {', '.join(METRICS)}")
    return found


def dimensions(a) -> Column:
    return F.size(vector(a))
