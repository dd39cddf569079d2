"""Exact order statistics and quantiles of a column that is neither sorted nor held in one place.

Selection by narrowing: values are counted in ``BINS`` equal parts of the range from
the smallest to the largest, each with its own smallest and largest value.  A wanted
place lies in one of these parts, whose values are counted again in ``BINS`` parts, until
the part is a single value, or so few are left in all parts that they are fetched.
All places go through the same passes, and a pass is one aggregation with a partial step on
each partition; the driver sees counts of parts only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a range in each pass, and rows of which the driver fetches the values at the end, at most.
BINS, FEW = 4096, 20_000
_INF = float("inf")


def _part(low: float, high: float) -> Column:
    """The part of a value between ``low`` and ``high``; infinities have parts of their own.  Never falls as values rise."""
    v = F.col("v")
    width = high / 2 - low / 2  # halves: the difference of two doubles may be none
    inside = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(BINS - 1.0), (v / 2 - low / 2) / width * BINS))) if width > 0 else F.when(v <= low, 0).otherwise(BINS - 1)
    return F.when(v == -_INF, -1).when(v == _INF, BINS).otherwise(inside).cast("int")


def order_statistics(table: DataFrame, column: str, places: list[int] | None = None, shares: list[float] | None = None) -> list[float | None]:
    """Values of a numeric column (as doubles) at ``places`` of its ascending order, from 0; null values aren't counted.

    NaN is larger than all numbers.  A place beyond either end gives None.  With ``shares`` instead, the
    values at both places around each share of the way from first to last: ``low, high, weight`` of each, flat.
    """
    values = table.select(F.col(column).cast("double").alias("v")).where("v is not null").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        finite = F.when(F.abs("v") < _INF, F.col("v"))  # not NaN: it isn't below
        number = F.when(~F.isnan("v"), F.col("v"))
        numbers, total, low, high, least, most = values.agg(F.count(number), F.count("v"), F.min(finite), F.max(finite), F.min(number), F.max(number)).first()
        if shares is not None:
            at = [(total - 1) * s for s in shares]
            places = [p for x in at for p in (math.floor(x), math.ceil(x))] if total else [-1] * 2 * len(at)
        found: dict[int, float | None] = {p: None if not 0 <= p < total else math.nan for p in places}
        open_parts = {}  # (smallest, largest, finite ones of these, values below it, values) -> places
        if least is not None:
            open_parts[least, most, low, high, 0, numbers] = [p for p in found if 0 <= p < numbers]
        numbers_only = values.where(~F.isnan("v"))
        while open_parts := _settle(open_parts, found):
            parts = list(open_parts)
            inside = reduce(lambda a, b: a | b, [F.col("v").between(p[0], p[1]) for p in parts])
            rest = numbers_only.where(inside)
            if sum(p[5] for p in parts) <= FEW:
                _pick(sorted(rest.groupBy("v").count().collect()), open_parts, found)
                break
            which = reduce(lambda c, i: c.when(F.col("v").between(parts[i][0], parts[i][1]), F.struct(F.lit(i).alias("i"), _part(parts[i][2], parts[i][3]).alias("b"))), range(len(parts)), F)
            counts = rest.groupBy(which.alias("k")).agg(F.count("*"), F.min("v"), F.max("v"), F.min(finite), F.max(finite)).collect()
            counts = sorted((r[0]["i"], r[0]["b"], *r[1:]) for r in counts)
            wanted, open_parts = open_parts, {}
            for i, part in enumerate(parts):
                below, left = part[4], sorted(wanted[part])
                for _, _, n, *edges in (c for c in counts if c[0] == i):
                    if here := [p for p in left if below <= p < below + n]:
                        open_parts[*edges, below, n] = here
                    below += n
    finally:
        values.unpersist()
    out = [found[p] for p in places]
    return out if shares is None else [x for i, share in enumerate(at) for x in (out[2 * i], out[2 * i + 1], share - math.floor(share))] if total else [None] * 3 * len(at)


def _settle(parts: dict, found: dict) -> dict:
    """Parts of one value answer their places; the others stay."""
    for part in [p for p in parts if p[0] == p[1] or not parts[p]]:
        for place in parts.pop(part):
            found[place] = part[0]
    return parts


def _pick(values: list, parts: dict, found: dict) -> None:
    """Answers from all values left and their counts."""
    for (low, high, _, _, below, _), places in parts.items():
        for value, n in values:
            if low <= value <= high:
                found.update({p: value for p in places if below <= p < below + n})
                below += n


def quantiles(table: DataFrame, column: str, *shares: float) -> list[float | None]:
    """Exact quantiles with linear interpolation, of all values that aren't null; None for each if there is none."""
    flat = order_statistics(table, column, shares=list(shares))
    out = []
    for low, high, weight in zip(flat[::3], flat[1::3], flat[2::3], strict=True):
        out.append(low if low is None or low == high or weight == 0 else (1 - weight) * low + weight * high)
    return out
