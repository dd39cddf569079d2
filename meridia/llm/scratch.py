"""Intermediate tables in the folder that the cluster shares.

A plan is cut by writing a DataFrame as Parquet below ``spark.checkpoint.dir``
and reading it again, so a lost executor costs a re-read and not a recompute.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


#: Rows and bytes of an Arrow batch, where the session doesn't say otherwise: whole texts are long rows, and a
#: batch is held by the JVM and by the worker, on the way in and on the way out.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches in this session; settings that the session already has stay."""
    for name, value in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or in local mode (tests) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.gettempdir().rstrip("/") + "/meridia-scratch"


def new_folder(spark: SparkSession) -> str:
    """A folder of the shared one that isn't there yet; it goes with the session."""
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame over the files."""
    spark = df.sparkSession
    bound_batches(spark)
    path, schema = new_folder(spark), df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path  # for drop()
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that ``materialize`` returned."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the files of shuffles that no plan refers to any more."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def release_memory() -> None:
    """Give a worker's freed memory back to the system: workers outlive a task, and other stages need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and freed memory goes back when a task is over."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return whole


class Kept:
    """One object that a Python worker keeps from task to task, and gives up after some idle seconds.

    Workers outlive a stage, so what they keep would stay in the executor's
    memory while other stages run.
    """

    def __init__(self, seconds: float = 3.0):
        self.seconds, self.lock = seconds, threading.Lock()
        self.key = self.value = self.timer = None

    def take(self, key: object, build: Callable[[], object]) -> object:
        with self.lock:
            if self.timer:
                self.timer.cancel()
            self.timer = None
            if self.key != key:
                self.key, self.value = key, build()
            return self.value

    def rest(self) -> None:
        """A task is over: keep the object for a while."""
        with self.lock:
            if self.timer:
                self.timer.cancel()
            self.timer = threading.Timer(self.seconds, self._forget)
            self.timer.daemon = True
            self.timer.start()

    def _forget(self) -> None:
        with self.lock:
            if self.timer is threading.current_thread():
                self.key = self.value = self.timer = None


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return
