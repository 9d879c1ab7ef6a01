"""The newest version of each key of a stream, whatever the order in which versions arrive.

State of a key is its newest event time and a digest of what was emitted for it. A
version is emitted when it is newer than that (or equal and larger, so that the result
does not depend on order); rows later than the watermark are dropped, and a key's state
expires when the watermark has passed its time to live, after which nothing older than
the watermark can arrive. The emitted rows are an upsert log: of each key, the last one
by (event time, value) is current.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

#: What the state needs: several columns and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSIONS = StructType([StructField("key", StringType()), StructField("time", TimestampType()), StructField("value", StringType()), StructField("versions", LongType())])


class Newest(StatefulProcessor):
    """Keeps (time, value, versions seen) of one key; an expired key is forgotten."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", StructType([StructField("time", TimestampType()), StructField("value", StringType()), StructField("versions", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        time, value, n = self.state.get() if self.state.exists() else (None, None, 0)
        had, mark = (time, value), timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for t, v in zip(part["time"], part["value"]):
                t = pd.Timestamp(t)
                # Spark drops rows before the watermark only where an aggregation asks for it.
                if pd.isna(t) or t.timestamp() * 1000 < mark:
                    continue
                n += 1
                if time is None or (t, v or "") > (pd.Timestamp(time), value or ""):
                    time, value = t.to_pydatetime(), v
        if time is None:
            return
        self.state.update((time, value, n))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(pd.Timestamp(time).timestamp() * 1000) + self.keep_ms)
        if (time, value) != had:
            yield pd.DataFrame({"key": [key[0]], "time": [time], "value": [value], "versions": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def newest_versions(stream: DataFrame, key: str, time: str, value: str, late: str = "2 days", keep_days: float = 30) -> DataFrame:
    """An upsert log (key, time, value, versions) of a stream; the session must use PROVIDER for its state."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(value).cast("string").alias("value")).filter("key is not null")
    return rows.withWatermark("time", late).groupBy("key").transformWithStateInPandas(Newest(int(keep_days * 86_400_000)), VERSIONS, "Append", "EventTime")


def current(log: DataFrame) -> DataFrame:
    """(key, time, value): the last version of each key of an upsert log, or of a table of versions."""
    order = Window.partitionBy("key").orderBy(F.desc("time"), F.desc_nulls_last("value"))
    return log.filter("time is not null").withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("key", "time", "value")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, start, end, n) of runs of events with no gap longer than ``gap``; of a stream where ``late`` is given."""
    rows = events if late is None else events.withWatermark(time, late)
    return rows.groupBy(F.col(key).alias("key"), F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
