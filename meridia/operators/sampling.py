"""Repeatable samples and test sets; random numbers are hashes of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import uniform


def _random(seed: int, *keys):
    return F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), *[k.cast("string") for k in keys]), 256)


def uniform_sample(table: DataFrame, key: str, n: int, seed: int = 20260511) -> DataFrame:
    """n rows without replacement, by the hash of seed and key."""
    return table.orderBy(_random(seed, F.col(key)), key).limit(n)


def stratified_sample(table: DataFrame, key: str, stratum: str, n: int, seed: int = 20260511) -> DataFrame:
    """Round robin over strata: one row of each in every round, until n rows are taken.

    No stratum gives more than n rows, so each task sends its n first ones of a stratum only.
    """
    inner = Window.partitionBy(stratum).orderBy(_random(seed, F.col(key)), key)
    rounds = table.withColumn("round", F.row_number().over(inner)).where(F.col("round") <= n)
    return rounds.orderBy("round", _random(seed, F.col(stratum)), stratum).limit(n)


def anchors(refs: DataFrame, per_ref: int = 5, head: float = 30.0, tail: float = 30.0, longest: float = 10.0, jitter: float = 2.0, seed: int = 20260511) -> DataFrame:
    """Query places: evenly spaced in the usable span, jittered, clamped, rounded to milliseconds.

    ``refs``: ``ref_id, duration_sec``.  Returns ``query_id, ref_id, i, offset_sec``.
    """
    stop = F.col("duration_sec") - tail - longest
    rows = refs.where(stop >= head).select("ref_id", stop.alias("stop"), F.explode(F.sequence(F.lit(0), F.lit(per_ref - 1))).alias("i"))
    shift = (uniform(F.concat_ws(":", F.lit(str(seed)), F.col("ref_id").cast("string"), F.col("i").cast("string"))) * 2 - 1) * jitter
    at = F.lit(head) + (F.col("i") + 1) / (per_ref + 1) * (F.col("stop") - head) + shift
    offset = F.greatest(F.lit(head), F.least(F.col("stop"), F.round(at, 3)))
    return rows.select(F.format_string("ref_t%04d_q%d", F.col("ref_id"), F.col("i")).alias("query_id"), "ref_id", "i", offset.alias("offset_sec"))


def section_queries(sections: DataFrame, longest: float = 10.0, seed: int = 20260511) -> DataFrame:
    """One query in the middle of each section, jittered by half a second; numbered per track before short ones go.

    ``sections``: ``track_id, start_sec, end_sec, track_duration_sec``.
    """
    order = Window.partitionBy("track_id").orderBy("start_sec", "end_sec")
    rows = sections.withColumn("seq", F.row_number().over(order) - 1).withColumn("stop", F.least("end_sec", "track_duration_sec") - longest).where("stop >= start_sec")
    shift = uniform(F.concat_ws(":", F.lit(str(seed)), F.col("track_id").cast("string"), F.col("seq").cast("string"))) - 0.5
    offset = F.round(F.greatest(F.col("start_sec"), F.least(F.col("stop"), (F.col("start_sec") + F.col("stop")) / 2 + shift)), 3)
    return rows.select("track_id", "seq", offset.alias("offset_sec"))


def length_variants(queries: DataFrame, lengths: list[int]) -> DataFrame:
    """Every query at every length, at the same offset."""
    each = F.explode(F.array(*[F.lit(x) for x in lengths])).alias("length_sec")
    return queries.drop("length_sec").select("*", each).withColumn("label", F.concat(F.col("length_sec").cast("string"), F.lit("s")))
