"""Vectors as arrays; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    """Inner product."""
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def normalise(x: Column) -> Column:
    """Unit length, with a floor of 1e-12 under the norm."""
    length = F.greatest(norm(x), F.lit(1e-12))
    return F.transform(x, lambda v: v.cast("double") / length)


def axpy(x: Column, weight: Column, y: Column) -> Column:
    """``x + weight * y``."""
    return F.zip_with(x, y, lambda a, b: a.cast("double") + weight * b.cast("double"))


def finite(x: Column) -> Column:
    """No component is null, NaN or infinite."""
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def tile(x: Column, length: Column) -> Column:
    """Repeat an array to a length; an empty one stays empty."""
    times = F.ceil(length / F.greatest(F.size(x), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(x, times)), F.lit(1), length)


def windows(samples: Column, width: int, hop: int) -> Column:
    """Overlapping windows ``(at, window)``: no padding, the tail is dropped, none where it is too short."""
    n = F.floor((F.size(samples) - width) / hop).cast("int") + 1
    at = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.slice(samples, i * hop + 1, F.lit(width)).alias("window")))
