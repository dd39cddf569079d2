"""Five stages from a raw corpus to tokens: quality, line dedup, near dedup, decontamination, byte-level BPE.

Every stage takes ``(spark, docs, sf_dir)`` and all that the stage before it
kept; texts that a stage changes are what the next one reads.  All but the last
return the columns of ``docs``, whatever their names: columns that an operator
would replace are put aside and come back.  Repeated rows stay repeated, a null
doc_id is never linked with anything, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, quality
from .decontaminate import contaminated_words
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .scratch import materialize, release_memory

#: Documents score this or more to stay.
MIN_QUALITY = 0.7
_ASIDE = "__aside_"


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    return docs.withColumnsRenamed({c: _ASIDE + c for c in names if c in docs.columns})


def _back(out: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` only, under their own names and in their order."""
    return out.select(*[F.col(_ASIDE + c if _ASIDE + c in out.columns else c).alias(c) for c in like.columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts; null and empty texts are scored like others."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    release_memory()  # of the sample
    return _back(quality.score_documents(_aside(docs, "score"), model).where(F.col("score") >= MIN_QUALITY), docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines.

    A document that lost lines and has only white space left goes; others, null
    and empty texts too, stay as they are.  ``n_chars`` follows the text.
    """
    release_memory()
    kept = dedup_lines(_aside(docs, "n_lines", "n_removed")).where(F.col("n_removed").eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _back(kept, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id; texts without words all stay."""
    release_memory()
    gone = near_duplicates(docs, percent=80).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.

    What a text holds is what counts, so texts are judged, each different one once: rows that share
    a doc_id, or have none, are judged each by its own text.
    """
    release_memory()
    texts = docs.where("text is not null").select(F.md5("text").alias("doc_id"), "text")
    found = contaminated_words(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where("size(hits) > 0").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.md5("text") == F.col("__gone"), "left_anti")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, token_ids, n_tokens, round_trip``: token ids of each document, and whether decoding gives its text back.

    A null text has no tokens and comes back as the empty one.
    """
    release_memory()
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    ids = ids.select("doc_id", "text", F.col("ids").alias("token_ids"), "ids")
    done = bpe.decode(ids, ranks)
    return done.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte-level BPE", tokenise),
]


def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over ``docs``, each written and read again."""
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
