"""A written index of hashes: recordings with ids, their hashes in buckets, and what could not be stored.

Three tables of the session's catalog, with files below one shared folder:

* ``<name>_songs``: ``song_id, ref_id, source_md5, n_hashes``, a row when an id is given (0 hashes) and one
  when all hashes are there, so the row of the most hashes holds;
* ``<name>_hashes``: ``hash, part, song_id, t``, distinct, in buckets of ``(hash, part)``;
* ``<name>_failures``: ``ref_id, reason``.

``part`` deals the recordings of one hash to ``PARTS`` groups, so that a hash that a third of all
rows share is spread over as many buckets; queries are sent to all parts.  Votes join on both
columns, for which the stored side is in place: only queries are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import new_folder
from .numbering import numbered

#: Groups of the recordings of a hash, and buckets of the table (a parameter of ``create``; more for larger tables).
PARTS, BUCKETS = 8, 32
#: Hashes of a bucket, about, where buckets are chosen by size: a task sorts them in memory.
BUCKET_ROWS = 1_500_000
#: Recordings of an insert whose ids are sent to all tasks; more are joined by a shuffle of their hashes.
BROADCAST_IDS = 4_000_000
MISSING_MD5, NO_HASHES = "missing source_md5", "no hashes"


@dataclass(frozen=True)
class HashStore:
    spark: SparkSession
    name: str
    folder: str
    buckets: int

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def ids(self) -> DataFrame:
        """``song_id, ref_id, source_md5, n_hashes`` of all recordings with an id; 0 hashes while the first insert isn't done."""
        return self.table("songs").groupBy("song_id", "ref_id").agg(F.max_by("source_md5", "n_hashes").alias("source_md5"), F.max("n_hashes").alias("n_hashes"))

    def songs(self) -> DataFrame:
        """Recordings whose hashes are all there."""
        return self.ids().where("n_hashes > 0")

    def failures(self) -> DataFrame:
        """``ref_id, reason`` of recordings that aren't stored; one that was stored later isn't among them."""
        return self.table("failures").distinct().join(self.songs().select("ref_id"), "ref_id", "left_anti")

    def hashes(self) -> DataFrame:
        """``ref_id, hash, t`` of all recordings."""
        return self.table("hashes").join(self.songs().select("song_id", "ref_id"), "song_id").select("ref_id", "hash", "t")

    def _append(self, kind: str, rows: DataFrame) -> None:
        write = rows.write.mode("append").format("parquet").option("path", f"{self.folder}/{kind}")
        if kind == "hashes":
            write = write.bucketBy(self.buckets, "hash", "part").sortBy("hash", "part")
        write.saveAsTable(f"{self.name}_{kind}")


def create(spark: SparkSession, refs: DataFrame, buckets: int = BUCKETS) -> HashStore:
    """An empty store for recordings whose ``ref_id`` has the type of the one of ``refs``."""
    store = HashStore(spark, f"hashes_{uuid.uuid4().hex}", new_folder(spark), buckets)
    kind = refs.schema["ref_id"].dataType.simpleString()
    for name, columns in (("songs", f"song_id long, ref_id {kind}, source_md5 string, n_hashes long"), ("hashes", "hash long, part int, song_id long, t long"), ("failures", f"ref_id {kind}, reason string")):
        store._append(name, spark.createDataFrame([], columns))
    return store


def buckets_for(hashes: int) -> int:
    """Buckets for about so many hashes."""
    return max(BUCKETS, -(-hashes // BUCKET_ROWS))


def drop(store: HashStore) -> None:
    """Remove the tables; the files go with the session's folders."""
    for kind in ("songs", "hashes", "failures"):
        store.spark.sql(f"DROP TABLE IF EXISTS {store.name}_{kind}")


def insert(store: HashStore, refs: DataFrame, hashes: DataFrame) -> None:
    """Store recordings ``ref_id, source_md5, duration_sec`` with their ``ref_id, hash, t``; what is there stays.

    Recordings are numbered on from the last id, the longest first.  One that has an id already
    keeps it, and only hashes that it didn't have are appended.  Ids are written before hashes and a
    recording has no votes before all its hashes are there, so an insert that was cut
    short can be sent again, or not.  A recording without a
    checksum of 32 characters, or without hashes, becomes a row of the failures.
    Rows without a ``ref_id`` are left out; of several of one, the longest counts.
    """
    spark = store.spark
    fresh = f"{store.folder}/insert-{uuid.uuid4().hex}"
    one = Window.partitionBy("ref_id").orderBy(F.desc("duration_sec"), "source_md5")
    refs = refs.select("ref_id", F.trim("source_md5").alias("source_md5"), "duration_sec").where("ref_id is not null")
    refs = refs.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    rows = hashes.where("hash is not null and t is not null").select("ref_id", F.col("hash").cast("long").alias("hash"), F.col("t").cast("long").alias("t"))
    counted = refs.join(rows.groupBy("ref_id").agg(F.count("*").alias("given")), "ref_id", "left")  # repeated ones count here
    bad = F.when(F.coalesce(F.length("source_md5"), F.lit(0)) != 32, MISSING_MD5).when(F.col("given").isNull(), NO_HASHES)
    counted.withColumn("reason", bad).write.parquet(f"{fresh}/refs")
    counted = spark.read.parquet(f"{fresh}/refs")
    good = counted.where("reason is null")

    known = store.ids().select("song_id", "ref_id")
    last = known.agg(F.coalesce(F.max("song_id"), F.lit(0))).first()[0]
    news = good.join(known, "ref_id", "left_anti").withColumn("shorter", -F.coalesce("duration_sec", F.lit(0.0)))
    order = numbered(news.select("shorter", "ref_id", "source_md5"), ["shorter", "ref_id"], f"{fresh}/order")
    order.select((F.col("n") + 1 + last).alias("song_id"), "ref_id", "source_md5", F.lit(0).cast("long").alias("n_hashes")).write.parquet(f"{fresh}/songs")
    store._append("songs", spark.read.parquet(f"{fresh}/songs"))

    store.ids().join(good.select("ref_id", "given"), "ref_id").write.parquet(f"{fresh}/ids")
    ids = spark.read.parquet(f"{fresh}/ids")
    of = ids.select("ref_id", "song_id")
    part = F.pmod(F.xxhash64("song_id"), F.lit(PARTS)).cast("int")
    rows = rows.join(F.broadcast(of) if ids.count() <= BROADCAST_IDS else of, "ref_id").select("hash", part.alias("part"), "song_id", "t")
    # hashes move once, to their buckets, where repeated ones and those that are there fall away
    seen = Observation()
    with _some_keys_suffice(spark):
        absent = _absent(store, rows, last > 0).observe(seen, F.count_if(F.col("song_id") > last).alias("new"))
        store._append("hashes", absent)
    store._append("failures", counted.where("reason is not null").select("ref_id", "reason"))
    # a new recording has the hashes it came with, if none was repeated or there from an insert cut short; else it is counted
    fresh_ids, before = ids.where(F.col("song_id") > last), ids.where(F.col("song_id") <= last)
    whole = seen.get["new"] == fresh_ids.agg(F.coalesce(F.sum("given"), F.lit(0))).first()[0]
    done = fresh_ids.select("song_id", "ref_id", "source_md5", F.col("given").alias("n_hashes"))
    again = before if whole else ids
    if not again.isEmpty():
        held = store.table("hashes").groupBy("song_id").agg(F.count("*").alias("n_hashes"))
        held = again.drop("n_hashes", "given").join(held, "song_id")
        done = done.unionByName(held) if whole else held
    store._append("songs", done.select("song_id", "ref_id", "source_md5", "n_hashes"))


@contextmanager
def _some_keys_suffice(spark: SparkSession) -> Iterator[None]:
    """While a plan is made and run: sides dealt alike by some of a join's keys stay in place."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _absent(store: HashStore, rows: DataFrame, some: bool = True) -> DataFrame:
    """Distinct rows that the table (if it has ``some``) lacks, bucket by bucket: they are dealt as the table is, which stays in place."""
    dealt = rows.repartition(store.buckets, "hash", "part").dropDuplicates()
    return dealt.join(store.table("hashes"), ["hash", "part", "song_id", "t"], "left_anti") if some else dealt


def votes(store: HashStore, queries: DataFrame) -> DataFrame:
    """Votes on ``(query_id, ref_id, shift)`` from equal hashes of ``query_id, hash, t``, taken as a set."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    q = queries.select("query_id", "hash", F.col("t").alias("qt")).dropDuplicates().withColumn("part", parts)
    found = q.join(store.table("hashes"), ["hash", "part"]).groupBy("query_id", "song_id", (F.col("t") - F.col("qt")).alias("shift")).agg(F.count("*").alias("votes"))
    return found.join(store.songs().select("song_id", "ref_id"), "song_id").select("query_id", "ref_id", "shift", "votes")


def confidences(store: HashStore, ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Votes as a share of the query's hashes, and of those that the store noted for the reference."""
    q = queries.select("query_id", "hash", "t").dropDuplicates().groupBy("query_id").agg(F.count("*").alias("query_hashes"))
    out = ranked.join(q, "query_id").join(store.songs().select("ref_id", F.col("n_hashes").alias("ref_hashes")), "ref_id")
    return out.withColumn("input_confidence", F.col("votes") / F.col("query_hashes")).withColumn("fingerprinted_confidence", F.col("votes") / F.col("ref_hashes"))
