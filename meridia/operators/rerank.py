"""Re-ranking of candidates: centroids, controls, inverted softmax, CSLS."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.stats import rounded
from ..sources.folders import new_folder
from .numbering import numbered


def vector_sums(table: DataFrame, *keys: str, column: str = "embedding") -> DataFrame:
    """Sum (double) and number of the vectors of each group: ``*keys, total, n``."""
    long = table.select(*keys, F.posexplode(column).alias("d", "x"))
    sums = long.groupBy(*keys, "d").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    out = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("l"), F.max("n").alias("n"))
    return out.select(*keys, F.transform("l", lambda v: v["s"]).alias("total"), "n")


def leave_one_out(library: DataFrame) -> DataFrame:
    """``ref_id, artist, centroid``: the mean of the artist's other recordings, zero if there is none."""
    refs = vector_sums(library, "artist", "ref_id")
    artists = vector_sums(library, "artist").select("artist", F.col("total").alias("all"), F.col("n").alias("n_all"))
    left = F.col("n_all") - F.col("n")
    mean = F.zip_with("all", "total", lambda a, b: F.when(left > 0, (a - b) / F.greatest(left, F.lit(1))).otherwise(0.0))
    return refs.join(artists, "artist").select("ref_id", "artist", mean.alias("centroid"))


def _bits(*parts: Column) -> Column:
    """52 random bits, as a whole number, from the SHA-256 of the parts joined by colons."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("long")


def shuffled(centroids: DataFrame, folder: str | None = None, seed: int = 20260512) -> DataFrame:
    """Control: each recording gets the centroid of a recording of another artist, picked by hash (null, if there is none).

    Recordings stand in the order of artist and hash, so those of other artists
    are all places outside of one interval; a hash picks one of them.  An equi-join
    on places fetches the donor's centroid.
    """
    placed = numbered(centroids.withColumn("h", _bits(F.lit(seed), F.col("ref_id"))), ["artist", "h", "ref_id"], folder or new_folder(centroids.sparkSession), "place")
    total = F.lit(centroids.count())
    artists = placed.groupBy("artist").agg(F.min("place").alias("first"), F.count("*").alias("own"))
    others = total - F.col("own")
    pick = F.pmod(F.col("first") + F.col("own") + F.pmod(F.col("h"), F.greatest(others, F.lit(1))), total)
    asked = placed.join(artists, "artist").select("ref_id", "artist", F.when(others > 0, pick).alias("place"))
    donors = placed.select("place", F.col("ref_id").alias("donor"), "centroid")
    return asked.join(donors, "place", "left").select("ref_id", "artist", "donor", "centroid")


def isotropic(centroids: DataFrame, seed: int = 20260513) -> DataFrame:
    """Control: a random direction (Box-Muller from hashes) of the same norm as the centroid."""
    at = F.sequence(F.lit(1), F.size("centroid"))
    unit = lambda i, s: (_bits(F.lit(seed), F.lit(s), F.col("ref_id"), i) + 1) / F.lit(float((1 << 52) + 1))
    noise = F.transform(at, lambda i: F.sqrt(-2 * F.log(unit(i, 0))) * F.cos(2 * 3.141592653589793 * unit(i, 1)))
    out = centroids.withColumn("noise", noise)
    length, own = V.norm(F.col("centroid")), F.greatest(V.norm(F.col("noise")), F.lit(1e-12))
    return out.select("ref_id", "artist", F.transform("noise", lambda x: x * length / own).alias("centroid"))


#: Shares of the centroid taken off, and the one of the controls.
ALPHAS, CONTROL_ALPHA = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3), 0.1


def variants() -> list[tuple[str, str, float]]:
    """``(variant, kind of centroid, alpha)`` of a whole sweep."""
    return [(f"alpha_{a:.2f}", "own", a) for a in ALPHAS] + [(f"control_{k}", k, CONTROL_ALPHA) for k in ("shuffled", "isotropic")]


def sweep(cands: DataFrame, queries: DataFrame, library: DataFrame, centroids: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """Rescore shared candidates for every variant: ``query_id, variant, cand, score, rank``.

    Library vectors count as ``(e - alpha * centroid)`` at unit length; queries stay.  ``centroids``: by
    kind, ``ref_id, centroid``; a missing one takes nothing off.  Only vectors of candidates are
    fetched, once for all variants: a product with the moved vector follows from the inner products of query,
    vector and centroid.
    """
    from .retrieval import along_diagonals, top_k

    for kind, table in centroids.items():
        library = library.join(table.select("ref_id", F.col("centroid").alias(kind)), "ref_id", "left")
        library = library.withColumn(kind, F.coalesce(kind, F.array_repeat(F.lit(0.0), F.size("embedding"))))
    kinds, wanted = list(centroids), variants()

    def moved(q: np.ndarray, e: np.ndarray, *means: np.ndarray) -> np.ndarray:
        dot = lambda x, y: np.einsum("ij,ij->i", x, y)
        qe, ee = dot(q, e), dot(e, e)
        products = {kind: (dot(q, m), dot(e, m), dot(m, m)) for kind, m in zip(kinds, means, strict=True)}
        out = []
        for _, kind, alpha in wanted:
            qm, em, mm = products[kind]
            out.append((qe - alpha * qm) / np.maximum(np.sqrt(np.maximum(0.0, ee - 2 * alpha * em + alpha * alpha * mm)), 1e-12))
        return np.stack(out, axis=1)

    found = along_diagonals(cands, queries, library, ["embedding", *kinds], moved)
    scores = [F.struct(F.lit(name).alias("variant"), rounded(F.get("values", F.lit(i)), 6).alias("score")) for i, (name, _, _) in enumerate(wanted)]
    scores = found.select("query_id", "cand", F.inline(F.array(*scores)))
    return top_k(scores.select("query_id", "variant", "cand", "score"), k, "variant")


#: Anchors of a re-ranking, at most: they are sent to every task.
MOST_ANCHORS = 4096


def _anchor_products(rows: DataFrame, column: str, anchors: DataFrame, out: str, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``rows`` without ``column``, and ``out``: ``of`` applied to each row's inner products with all anchors."""
    fetched = anchors.select("anchor_id", "embedding").limit(MOST_ANCHORS + 1).toArrow()
    if len(fetched) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    matrix = np.array(fetched["embedding"].to_pylist(), float).reshape(len(fetched), -1)
    shipped = rows.sparkSession.sparkContext.broadcast(matrix)  # MOST_ANCHORS vectors, at most
    keys = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                own = np.asarray(part.column(column).flatten(), float).reshape(len(part), -1)
                found = of(own @ shipped.value.T) if len(part) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keys], pa.array(found, pa.float64())], [*keys, out])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys]
    return rows.mapInArrow(run, ", ".join([*kinds, f"{out} double"]))


def _hood(rows: DataFrame, key: str, column: str, anchors: DataFrame, k: int, out: str) -> DataFrame:
    """``key`` and ``out``: each row's mean product with its k nearest anchors, of any number, by tiles."""
    from .retrieval import knn

    asked = rows.select(F.col(key).alias("query_id"), F.lit(0).cast("long").alias("q_off"), F.col(column).alias("embedding"))
    found = knn(asked, anchors.select(F.col("anchor_id").alias("global_idx"), "embedding"), k)
    return found.groupBy(F.col("query_id").alias(key)).agg(F.avg("ip").alias(out))


def _centres(queries: DataFrame) -> DataFrame:
    return vector_sums(queries, "query_id").select("query_id", F.transform("total", lambda x: x / F.col("n")).alias("c"))


def inverted_softmax(scores: DataFrame, anchors: DataFrame, queries: DataFrame, tau: float = 0.05) -> DataFrame:
    """Divide ``exp(score / tau)`` by the query's sum over anchors; rankings stay as they are."""
    sums = _anchor_products(_centres(queries), "c", anchors, "z", lambda p: np.exp(p / tau).sum(axis=1))
    return scores.join(sums, "query_id").withColumn("score", F.exp(F.col("score") / tau) / F.col("z")).drop("z")


def csls(scores: DataFrame, anchors: DataFrame, queries: DataFrame, library: DataFrame, k: int = 10) -> DataFrame:
    """``score - (q + r) / 2``: q and r are mean products of the query and of the candidate's first segment with their k nearest anchors, of any number."""
    folder = new_folder(scores.sparkSession)  # scores are read three times
    scores.write.parquet(folder)
    scores = scores.sparkSession.read.schema(scores.schema).parquet(folder)
    first = library.select(F.col("global_idx").alias("cand"), "embedding").join(scores.select("cand").distinct(), "cand")
    q_mean = _hood(_centres(queries), "query_id", "c", anchors, k, "q_mean")
    r_mean = _hood(first, "cand", "embedding", anchors, k, "r_mean")
    out = scores.join(q_mean, "query_id").join(r_mean, "cand")
    return out.withColumn("score", rounded(F.col("score") - (F.col("q_mean") + F.col("r_mean")) / 2, 6)).drop("q_mean", "r_mean")
