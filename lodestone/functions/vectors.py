"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product, added from the first element on; of unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def vector_error(a: Column, dimension: int, tolerance: float = 1e-5) -> Column:
    """Why a vector is refused (dimension, not finite, not of unit length), or null."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        F.when(a.isNull() | (F.size(a) != dimension), F.lit("dimension"))
        .when(~finite, F.lit("not_finite"))
        .when(F.abs(norm(a) - 1) > tolerance, F.lit("not_unit"))
    )
