"""Vector measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def normalized(a: str | Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), length))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays as sets."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))
