"""Quality gates of an encoder, measured in one aggregate that can fail the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Least cosine of a stored vector with its new one, and what two runs may differ by.
STORED, SAME_RUN = 0.95, 1e-6


def encoder_gates(stored: DataFrame, fresh: DataFrame, again: DataFrame, altered: DataFrame, margin: float = 0.1, require: bool = False) -> DataFrame:
    """One row: ``n, stored_cos, determinism, same_cos, other_cos`` and whether each gate, and all, are passed.

    All inputs are ``clip_id, segment_idx, embedding`` of one encoder: as stored, encoded now, encoded once more,
    and encoded from slightly altered samples.  The least cosine of stored and fresh vectors must be more than
    ``STORED``; two runs may differ by ``SAME_RUN`` at most; and altered segments must be nearer to their own
    originals than to those half a clip away, by ``margin`` on average.  Without any pair no gate is
    passed.  ``require`` makes the plan fail where a gate isn't.
    """
    keys = ["clip_id", "segment_idx"]
    named = lambda t, name: t.select(*keys, F.col("embedding").alias(name))
    rows = named(fresh, "fresh").join(named(stored, "stored"), keys, "left").join(named(again, "again"), keys, "left").join(named(altered, "altered"), keys, "left")
    # another segment of the same clip: half of its segments further on
    counted = rows.groupBy("clip_id").agg(F.count("*").alias("of"))
    far = rows.join(counted, "clip_id").where("of > 1").select("clip_id", F.pmod(F.col("segment_idx") + F.floor(F.col("of") / 2), F.col("of")).alias("segment_idx"), F.col("altered").alias("far"))
    rows = rows.join(far, keys, "left")
    cos = lambda a, b: V.dot(F.col(a), F.col(b)) / F.greatest(V.norm(F.col(a)) * V.norm(F.col(b)), F.lit(1e-12))
    drift = F.array_max(F.zip_with("fresh", "again", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    out = rows.agg(
        F.count("*").alias("n"), F.min(F.coalesce(cos("fresh", "stored"), F.lit(-1.0))).alias("stored_cos"), F.max(F.coalesce(drift, F.lit(float("inf")))).alias("determinism"),
        F.avg(cos("fresh", "altered")).alias("same_cos"), F.avg(cos("fresh", "far")).alias("other_cos"),
    )
    gates = {
        "stored_ok": F.col("stored_cos") > STORED,
        "deterministic": F.col("determinism") <= SAME_RUN,
        "discriminates": F.col("same_cos") - F.col("other_cos") > margin,
    }
    out = out.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in gates.items()})
    out = out.withColumn("passed", F.col("stored_ok") & F.col("deterministic") & F.col("discriminates"))
    if require:
        said = F.concat(F.lit("the encoder fails its gates: "), F.to_json(F.struct("stored_cos", "determinism", "same_cos", "other_cos")))
        out = out.where(F.assert_true(F.col("passed"), said).isNull())
    return out
