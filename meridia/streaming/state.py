"""A stateful stream: the last value of one kind of event, carried to the events after it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STATE = T.StructType([T.StructField("waiting", T.BinaryType()), T.StructField("last", T.BinaryType())])
_WAITING = pa.schema([("key", pa.string()), ("us", pa.int64()), ("event_id", pa.int64()), ("kind", pa.string()), ("value", pa.float64())])
_LAST = pa.schema([("key", pa.string()), ("value", pa.float64()), ("upto", pa.int64())])
#: Groups of keys that share a state, unless told otherwise.
GROUPS = 256


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class CarryForward(StatefulProcessor):
    """Rows of a key leave in the order of time and id, each with the last value of kind ``carry`` up to it.

    Rows wait in state until the watermark has passed them, so files may come in any order
    within its delay; a timer at the first waiting row lets them leave though no new row comes.  A row from
    before the time up to which its key's rows have left is too late and is dropped.  An
    event of kind ``reset`` forgets the value.  Rows of kind ``end`` only move the watermark.

    Keys (as text) share a state by groups, which is fetched and stored once for a batch, however many keys it has.
    """

    def __init__(self, carry: str, reset: str | None = None, end: str | None = None):
        self.carry, self.reset, self.end = carry, reset, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._leave(pd.concat(rows, ignore_index=True), timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._leave(None, timerValues)

    def _leave(self, new: pd.DataFrame | None, timers) -> Iterator[pd.DataFrame]:
        upto = timers.getCurrentWatermarkInMs()
        held = self.state.get() if self.state.exists() else None
        rows = _unpack(held[0]) if held else _WAITING.empty_table()
        last = {k: (v, gone) for k, v, gone in zip(*(c.to_pylist() for c in _unpack(held[1]).columns), strict=True)} if held else {}
        met = set()
        if new is not None:
            fresh = pa.Table.from_pandas(new[_WAITING.names], _WAITING, preserve_index=False)
            keys = fresh["key"].to_pylist()
            met = set(keys)
            gone = np.array([last[k][1] if k in last else 0 for k in keys], np.int64)
            keep = (np.asarray(fresh["us"]) // 1000 >= gone) & np.array([k != self.end for k in fresh["kind"].to_pylist()], bool)
            rows = pa.concat_tables([rows, fresh.filter(pa.array(keep))])
        ready = np.asarray(rows["us"]) // 1000 < upto
        out, ends = self._carried(rows.filter(pa.array(ready)), {k: v for k, (v, _) in last.items()})
        for k in met | set(ends):
            value, gone = last.get(k, (None, 0))
            if upto > gone:
                last[k] = (ends.get(k, value), upto)
        rows = rows.filter(pa.array(~ready))
        if len(rows):
            self.handle.registerTimer(int(np.asarray(rows["us"]).min()) // 1000 + 1)
        kept = pa.Table.from_arrays([pa.array(list(last), pa.string()), *(pa.array([x[i] for x in last.values()], t) for i, t in enumerate((pa.float64(), pa.int64())))], schema=_LAST)
        self.state.update((_pack(rows.combine_chunks()), _pack(kept)))
        if len(out):
            yield out

    def _carried(self, rows: pa.Table, last: dict[str | None, float | None]) -> tuple[pd.DataFrame, dict[str | None, float | None]]:
        """Rows in order with what is carried to each, and what each key carries after them."""
        frame = rows.to_pandas()
        who, names = pd.factorize(frame["key"], use_na_sentinel=False)
        kinds = pd.factorize(frame["kind"], sort=True)[0]
        order = np.lexsort((frame["value"], kinds, frame["event_id"], frame["us"], who))
        frame, who = frame.iloc[order], who[order]
        first = np.append(True, who[1:] != who[:-1])[: len(who)]
        names = [None if pd.isna(k) else k for k in names]
        reset = (frame["kind"] == self.reset).to_numpy(bool)
        carry = (frame["kind"] == self.carry).to_numpy(bool) & frame["value"].notna().to_numpy() & ~reset
        before = np.array([np.nan if last.get(k) is None else last[k] for k in names], float)
        value = np.where(carry, frame["value"].to_numpy(float), np.where(first & ~reset, before[who], np.nan))
        carried = value[np.maximum.accumulate(np.where(first | reset | carry, np.arange(len(who)), 0))] if len(who) else value
        final = np.append(first[1:], True)[: len(who)]
        ends = {names[k]: None if np.isnan(v) else float(v) for k, v in zip(who[final], carried[final], strict=True)}
        return pd.DataFrame({"key": frame["key"].to_numpy(), "event_id": frame["event_id"].to_numpy(), "carried": carried}), ends

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that carried state needs, while a stream starts."""
    name, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def carried(stream: DataFrame, key: str, carry: str, reset: str | None = None, end: str | None = None, late: str = "10 days", groups: int = GROUPS) -> DataFrame:
    """``key, event_id, carried`` of a stream of ``key, event_id, ts, event_type, value``.

    Rows later than the watermark (``late`` behind the newest time seen) are dropped; null times too.  Keys are dealt
    to ``groups``, each of which has to fit in a task with its waiting rows; a checkpoint holds for one number of groups.
    """
    from pyspark.sql import functions as F

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark("ts", late).where("ts is not null").select(F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), F.col("event_type").alias("kind"), F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    out = rows.groupBy("group").transformWithStateInPandas(CarryForward(carry, reset, end), "key string, event_id long, carried double", "Append", "EventTime")
    return out.select(F.col("key").cast(kind).alias("key"), "event_id", "carried")
