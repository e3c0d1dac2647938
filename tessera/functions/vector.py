"""Vector functions over array columns, in double precision, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different lengths or without direction."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def is_valid(a: Column) -> Column:
    """Not null, finite in all components and not zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(a.isNotNull() & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def unit(a: Column, digits: int = 8) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: F.round(x.cast("double") / n, digits)))
