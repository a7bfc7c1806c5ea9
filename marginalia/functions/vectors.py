"""Vector expressions: double arithmetic over arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of unlike width have none and count 0."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def normalise(v: Column) -> Column:
    """Unit length, or null where the vector is zero or holds something not finite."""
    length = norm(v)
    usable = ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (length > 0) & (length < F.lit(float("inf")))
    return F.when(usable, F.transform(v, lambda x: x / length))
