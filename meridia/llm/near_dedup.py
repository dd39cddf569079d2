"""MinHash near-dedup: one-permutation hashing, optimal densification, bands and stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import broadcast_if_small, linked_components
from .scratch import drop, materialize, tidy

SHINGLE_WORDS = 5
#: Signature bins; 25 bands of 5 miss a pair of similarity 0.8 once in 20,000 times, of 0.85 once in 2 million.
BINS, BANDS, WIDTH = 128, 25, 5


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of a batch ``(doc_id, text)``: first and last row, shingles and how many each row has."""
    data, offsets = K.string_buffers(batch.column("text"))
    for i, j in K.row_blocks(offsets):
        hashes, counts = K.words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        values, rows = K.shingles_of(hashes, counts, SHINGLE_WORDS)
        yield i, j, values, rows


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    probes = K.probe_table(BINS)
    for batch in batches:
        for i, j, values, rows in _rows(batch):
            counts = np.bincount(rows, minlength=j - i)
            sig = K.one_permutation(values, rows, j - i, BINS, probes)
            bands = K.band_keys(sig, BANDS, WIDTH)[counts > 0]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i),
                    pa.array(counts.astype(np.int64)),
                    pa.array(K.row_sums(values, counts).view(np.int64)),
                    pa.array(K.row_sums(K.mix(values ^ K.MULT[101]), counts).view(np.int64)),
                    K.int64_lists(bands.ravel(), np.where(counts > 0, BANDS, 0)),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, values, rows in _rows(batch):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), K.int64_lists(values, np.bincount(rows, minlength=j - i))], ["node", "body"]
            )


def _measure(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("common"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of five-word shingles are alike.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored.
    Words are runs of anything but ASCII white space, after lower-casing A-Z;
    a text of fewer than five words is one shingle.  Two documents are linked
    where ``100 * intersection >= percent * union`` of their sets.

    Returns, for every input row: ``doc_id, n_shingles, component_id, kept``;
    ``component_id`` is the smallest doc_id that links reach.

    Candidates come from bands of a one-permutation MinHash with optimal
    densification.  Documents with equal sets are one node; each bucket gives a
    star, confirmed on full sets (see ``graph.linked_components``).

    Null or empty texts, and texts of white space: no shingles, linked with
    nothing.  A null doc_id: linked with nothing, ``component_id`` null, kept.
    Repeated rows give the same row each.  An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = materialize(docs.mapInArrow(tidy(_signatures), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"))
    same = ["set_a", "set_b", "n_shingles"]
    usable = table.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(usable.groupBy(*same).agg(F.min("doc_id").alias("node")))

    firsts = usable.join(classes.select("node").withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    members = firsts.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node"))
    shared = materialize(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    members = materialize(members.join(broadcast_if_small(shared), "bucket", "left_semi"))

    needed = materialize(members.select(F.col("node").alias("doc_id")).distinct())
    sets = docs.join(broadcast_if_small(needed), "doc_id", "left_semi").mapInArrow(tidy(_sets), "node long, body array<long>")
    sets = materialize(sets.dropDuplicates(["node"]))

    parts = linked_components(members, sets, percent, _measure, lambda rows: rows.withColumnRenamed("body", "x"))
    for used in (shared, members, needed, sets):
        drop(used)
    named = classes.join(parts, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    out = table.drop("bands").join(named, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
