"""Exact search: block kNN, sequence search, hash votes, and ranked results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.stats import rounded

#: Rows of a tile of queries and of the library, about, and products held at once in a task.
QUERY_TILE, LIBRARY_TILE, PRODUCTS = 8192, 32_768, 2_000_000
#: A library is cut into this many tiles at least, if they keep some rows.
TILES, LEAST_TILE = 8, 256
#: Starts of a stretch of the library, clips that meet it at a time, and rows gathered at once in a task.
STRETCH, CLIPS, GATHERED = 32_768, 2_048, 16_384


def knn(queries: DataFrame, library: DataFrame, k: int) -> DataFrame:
    """The k library rows of the largest inner product for each query row, exactly.

    ``queries``: ``query_id, q_off, embedding``; ``library``: ``global_idx,
    embedding``, both unit vectors of one length.  Products are rounded to six
    places, ties go to the smaller ``global_idx``.  Both sides are dealt into tiles by hash, and each
    pair of tiles is one group of bounded size, which gives the k best of its rows to each of its
    queries; the best of these are merged, with a first step before the shuffle.  So the
    library moves once for every ``QUERY_TILE`` queries, and nothing goes through the driver.
    """
    n_library = library.count()
    q_tiles = max(1, -(-queries.count() // QUERY_TILE))
    l_tiles = max(1, -(-n_library // LIBRARY_TILE), min(TILES, n_library // LEAST_TILE))
    deal = lambda t, own, n, other, m, *keys: t.withColumn(own, F.pmod(F.xxhash64(*keys), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    left = deal(queries.select("query_id", "q_off", "embedding"), "qt", q_tiles, "lt", l_tiles, "query_id", "q_off")
    right = deal(library.select(F.col("global_idx").cast("long").alias("global_idx"), "embedding"), "lt", l_tiles, "qt", q_tiles, "global_idx")
    kinds = {c: queries.schema[c].dataType.simpleString() for c in ("query_id", "q_off")}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        who, at, ip = _tile_best(_matrix(left), np.asarray(right["global_idx"].combine_chunks()), _matrix(right), k)
        found = left.select(["query_id", "q_off"]).take(pa.array(who))
        return found.append_column("global_idx", pa.array(at, pa.int64())).append_column("ip", pa.array(ip, pa.float64()))

    schema = f"query_id {kinds['query_id']}, q_off {kinds['q_off']}, global_idx long, ip double"
    found = left.groupBy("qt", "lt").cogroup(right.groupBy("qt", "lt")).applyInArrow(run, schema)
    best = Window.partitionBy("query_id", "q_off").orderBy(F.desc("ip"), "global_idx")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _matrix(table: pa.Table, column: str = "embedding") -> np.ndarray:
    flat = table[column].combine_chunks().flatten()
    return np.asarray(flat, float).reshape(len(table), -1 if len(table) else 0)


def _tile_best(queries: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of ``base`` for each row of ``queries``: row of the query, id, product."""
    if not len(queries) or not len(base):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    parts = []
    step = max(1, PRODUCTS // len(base))  # each query meets the whole tile at once, so its best are sorted once
    for i in range(0, len(queries), step):
        ip = queries[i : i + step] @ base.T
        np.round(ip, 6, out=ip)
        bar = np.partition(ip, -k, axis=1)[:, -k] if len(base) > k else np.full(len(ip), -np.inf)
        row, col = np.nonzero(ip >= bar[:, None])
        at, ip = ids[col], ip[row, col]
        order = np.lexsort((at, -ip, row))
        row, at, ip = row[order], at[order], ip[order]
        best = np.arange(len(row)) - np.searchsorted(row, np.arange(len(bar)))[row] < k
        parts.append((row[best] + i, at[best], ip[best]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def candidates(hits: DataFrame, lengths: DataFrame, n_total: int) -> DataFrame:
    """Offset-compensated distinct starts ``(query_id, cand)`` whose whole sequence lies in the library."""
    cand = hits.select("query_id", (F.col("global_idx") - F.col("q_off")).alias("cand")).distinct()
    return cand.join(lengths, "query_id").where((F.col("cand") >= 0) & (F.col("cand") + F.col("length") <= n_total)).select("query_id", "cand")


def along_diagonals(cands: DataFrame, queries: DataFrame, library: DataFrame, vectors: list[str], of: Callable[..., np.ndarray]) -> DataFrame:
    """``query_id, cand, met, values``: means along each candidate's diagonal of what ``of`` says about its rows.

    The library's columns ``vectors`` are dealt to stretches of ``STRETCH`` starts, each with the rows that a clip
    from there on can reach.  A clip goes once, whole, to each stretch that holds candidates of it, so a vector isn't
    sent for every candidate; ``CLIPS`` of them meet a stretch at a time.  ``of`` gets the clip's
    rows and those of the library, one matrix for each of ``vectors``, and returns a row of numbers for each.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    parts = max(1, -(-queries.select("query_id").distinct().count() // CLIPS))
    reach = queries.agg(F.max("q_off")).first()[0] or 0
    clips = queries.groupBy("query_id").agg(F.collect_list(F.struct(F.col("q_off").cast("long").alias("q_off"), F.col("embedding").alias("q"))).alias("l"))
    clips = clips.select("query_id", F.col("l.q_off").alias("offs"), F.flatten("l.q").alias("q"))
    starts = cands.select("query_id", F.col("cand").cast("long").alias("cand")).groupBy("query_id", F.floor(F.col("cand") / STRETCH).alias("stretch")).agg(F.collect_list("cand").alias("cands"))
    left = starts.join(clips, "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    at = F.col("global_idx").cast("long")
    right = library.select(at.alias("global_idx"), *vectors, F.explode(F.sequence(F.floor((at - reach) / STRETCH), F.floor(at / STRETCH))).alias("stretch"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.asarray(right["global_idx"].combine_chunks())
        order = np.argsort(ids)
        ids, columns = ids[order], [_matrix(right, c)[order] for c in vectors]
        who, found, met, values = [], [], [], []
        for i in range(len(left) if len(ids) else 0):
            starts, offs = (np.asarray(left[c][i].values) for c in ("cands", "offs"))
            q = np.asarray(left["q"][i].values, float).reshape(len(offs), -1)
            step = max(1, GATHERED // len(offs))
            for low in range(0, len(starts), step):
                want = starts[low : low + step, None] + offs
                place = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
                there = ids[place] == want
                row, col = np.nonzero(there)
                got = of(q[col], *[c[place[row, col]] for c in columns])
                n = there.sum(axis=1)
                some = np.flatnonzero(n)
                who.append(np.full(len(some), i))
                found.append(starts[low : low + step][some])
                met.append(n[some])
                values.append(np.add.reduceat(got, np.searchsorted(row, some)) / n[some, None] if len(some) else got)
        if not who:
            return pa.table({"query_id": left["query_id"].slice(0, 0), "cand": pa.array([], pa.int64()), "met": pa.array([], pa.int64()), "values": pa.array([], pa.list_(pa.float64()))})
        flat = np.concatenate(values)
        ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
        return pa.table({"query_id": left["query_id"].take(pa.array(np.concatenate(who))), "cand": pa.array(np.concatenate(found)), "met": pa.array(np.concatenate(met)), "values": pa.ListArray.from_arrays(ends, flat.ravel())})

    return left.groupBy("part", "stretch").cogroup(right.groupBy("part", "stretch")).applyInArrow(run, f"query_id {kind}, cand long, met long, values array<double>")


def rescore(cands: DataFrame, queries: DataFrame, library: DataFrame, whole: bool = False) -> DataFrame:
    """Mean inner product along the diagonal of each candidate: ``query_id, cand, score``.

    ``whole`` leaves out candidates of which the library lacks a segment.
    """
    out = along_diagonals(cands, queries, library, ["embedding"], lambda q, e: np.einsum("ij,ij->i", q, e)[:, None])
    out = out.select("query_id", "cand", rounded(F.get("values", F.lit(0)), 6).alias("score"), "met")
    if whole:
        out = out.join(queries.groupBy("query_id").agg(F.count("*").alias("of")), "query_id").where("met = of")
    return out.select("query_id", "cand", "score")


def top_k(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """Rank by score, ties to the smaller candidate."""
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "cand")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sequence_search(queries: DataFrame, library: DataFrame, k_probe: int = 20, k: int = 10, within_ref: bool = False) -> DataFrame:
    """Search clips of several segments: probe, align, rescore, rank.

    ``within_ref`` leaves out candidates that run over the end of their
    recording; by default only the end of the library counts.
    """
    n_total = library.count()
    lengths = queries.groupBy("query_id").agg(F.count("*").alias("length"))
    cands = candidates(knn(queries, library, k_probe), lengths, n_total)
    if within_ref:
        ends = cands.join(lengths, "query_id").withColumn("last", F.col("cand") + F.col("length") - 1)
        ref = library.select("global_idx", "ref_id")
        ends = ends.join(ref.select(F.col("global_idx").alias("cand"), F.col("ref_id").alias("r1")), "cand").join(ref.select(F.col("global_idx").alias("last"), F.col("ref_id").alias("r2")), "last")
        cands = ends.where("r1 = r2").select("query_id", "cand")
    return top_k(rescore(cands, queries, library), k)


def emit(ranked: DataFrame, manifest: DataFrame, lookup: DataFrame, window: float = 1.0, hop: float = 0.5) -> DataFrame:
    """Result rows; a query without any answer gives one row of rank 0."""
    named = ranked.join(lookup.select(F.col("global_idx").alias("cand"), F.col("ref_id").alias("predicted_ref_id"), F.col("segment_start_sec").alias("ref_start")), "cand")
    out = manifest.select("query_id", "n_segments").join(named, "query_id", "left")
    span = (F.col("n_segments") - 1) * hop + window
    return out.select(
        "query_id", F.coalesce("rank", F.lit(0)).alias("rank"), "predicted_ref_id", F.col("cand").alias("predicted_segment_id"), "score", "ref_start",
        (F.col("ref_start") + span).alias("ref_stop"), F.when(F.col("cand").isNotNull(), 0.0).alias("query_start"), F.when(F.col("cand").isNotNull(), span).alias("query_stop"),
    )


def hash_votes(queries: DataFrame, library: DataFrame) -> DataFrame:
    """Votes on ``(query_id, ref_id, shift)`` from equal hashes; both sides ``(id, hash, t)``, as sets."""
    q = queries.select("query_id", "hash", F.col("t").alias("qt")).dropDuplicates()
    r = library.select("ref_id", "hash", F.col("t").alias("rt")).dropDuplicates()
    return q.join(r, "hash").groupBy("query_id", "ref_id", (F.col("rt") - F.col("qt")).alias("shift")).agg(F.count("*").alias("votes"))


def best_per_ref(votes: DataFrame, k: int = 10) -> DataFrame:
    """The best shift of each reference (first one on ties), and the k references of most votes."""
    one = Window.partitionBy("query_id", "ref_id").orderBy(F.desc("votes"), "shift")
    best = votes.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "ref_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def confidences(ranked: DataFrame, queries: DataFrame, library: DataFrame) -> DataFrame:
    """Votes as a share of the query's and of the reference's hashes."""
    q = queries.select("query_id", "hash", "t").dropDuplicates().groupBy("query_id").agg(F.count("*").alias("query_hashes"))
    r = library.select("ref_id", "hash", "t").dropDuplicates().groupBy("ref_id").agg(F.count("*").alias("ref_hashes"))
    out = ranked.join(q, "query_id").join(r, "ref_id")
    return out.withColumn("input_confidence", F.col("votes") / F.col("query_hashes")).withColumn("fingerprinted_confidence", F.col("votes") / F.col("ref_hashes"))


def word_hashes(table: DataFrame, key: str, text: str = "text", n: int = 3) -> DataFrame:
    """n-grams of white-space tokens with their positions, as stand-ins for peak hashes: ``(key, hash, t)``."""
    words = table.select(key, F.split(text, " ").alias("w"))
    count = F.size("w") - (n - 1)
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return words.select(key, "w", F.explode(at).alias("t")).select(key, F.xxhash64(F.array_join(F.slice("w", F.col("t") + 1, n), " ")).alias("hash"), F.col("t").cast("long").alias("t"))
