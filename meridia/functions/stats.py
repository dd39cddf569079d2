"""Statistics of evaluation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile of 95 % intervals, and the level over eight cells.
Z = 1.96
BONFERRONI = 0.05 / 8


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper bound of a share, clamped to [0, 1]; (0, 0) where n is 0."""
    n = n.cast("double")
    safe = F.greatest(n, F.lit(1.0))
    p = hits / safe
    centre = (p + z * z / (2 * safe)) / (1 + z * z / safe)
    half = z * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe)) / (1 + z * z / safe)
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    return low, F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(0.0)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs; 1 where there are none.

    The binomial terms are added in log space, so many pairs do not underflow.
    """
    b, c = b.cast("double"), c.cast("double")
    n, m = b + c, F.least(b, c)
    steps = F.when(m > 0, F.sequence(F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct((n * F.log(F.lit(0.5))).alias("t"), F.exp(n * F.log(F.lit(0.5))).alias("s"))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i)).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i))).alias("s"))
    return F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step, lambda a: a["s"]))


def rate(part: Column, whole: Column) -> Column:
    """A share with a guarded denominator."""
    return part / F.greatest(whole, F.lit(1))


def rounded(x: Column, places: int) -> Column:
    """A double to so many places, halves away from zero; a negative one that rounds to zero stays -0.0, as in the SQL.

    ``F.round`` loses the sign of zero and rounds the shortest decimal form, not the number itself.
    """
    scaled = F.abs(x * F.lit(10.0**places))
    whole = F.floor(scaled).cast("double")
    up = (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**places)
    there = scaled / F.lit(10.0**places)  # scaled, it is a whole number; the way back may cost a digit, as in the SQL
    up = F.when(scaled < 2.0**52, up).when(scaled < float("inf"), there)
    return F.when(up.isNotNull() & (x != 0), F.when(x < 0, -up).otherwise(up)).otherwise(x)
