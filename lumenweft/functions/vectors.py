"""Expressions on vectors stored as arrays; sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def dot_literal(v: Column, query: list[float]) -> Column:
    """Dot product with a literal vector, unrolled so that it joins whole-stage code generation."""
    out = F.lit(0.0)
    for i, q in enumerate(query):
        out = out + v[i].cast("double") * F.lit(float(q))
    return out


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def normalized(v: Column) -> Column:
    """The unit vector as floats; null if the norm is 0."""
    return F.when(norm(v) > 0, F.transform(doubles(v), lambda x: (x / norm(v)).cast("float")))


def valid(v: Column) -> Column:
    """Not null, not empty, all finite, and of positive norm."""
    finite = F.forall(doubles(v), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & (norm(v) > 0), F.lit(False))


def unit(v: Column, tolerance: float = 5e-3) -> Column:
    """Whether the squared norm is within ``tolerance`` of 1."""
    return F.abs(total(F.transform(doubles(v), lambda x: x * x)) - 1.0) <= tolerance


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either norm is 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 0.0).otherwise(dot(a, b) / lengths)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
