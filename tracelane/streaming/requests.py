"""Requests as a stream: the same filter, deduplication, bins and load, incrementally.

An extension: batch operators stay the measure of results. Rejected and late rows keep their reason, as in batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelane.operators.requests import add_metrics, with_reasons


def request_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New Parquet files below a path, with event_time from the start in nanoseconds."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("event_time", F.timestamp_micros(F.floor(F.col("request_start_ns") / 1000)))


def split(stream: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """The profiled rows with derived metrics, and the excluded ones with their reason: stateless."""
    r = with_reasons(stream, **how)
    return add_metrics(r.where("exclusion_reason is null").drop("exclusion_reason")), r.where("exclusion_reason is not null")


def without_repeats(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(keys)


def binned(stream: DataFrame, keys: list[str], value: str, width: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """Mean and count for each tumbling window and key."""
    return stream.withWatermark("event_time", delay).groupBy(F.window("event_time", width), *keys).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_samples"))


LOAD = "lane string, at_ns long, in_flight long"
HELD = "pending array<struct<at:long,change:int>>, level long, done long"


def in_flight(stream: DataFrame, lane: str, delay: str = "1 hour") -> DataFrame:
    """The load of each lane after every change, ends before starts at one time. Changes are held until the watermark
    has passed them, so they come out in order; rows that come later than the watermark are dropped by Spark."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, level, done = list(state.get[0]) if state.exists else [], state.get[1] if state.exists else 0, state.get[2] if state.exists else -(2**62)
        for f in frames:
            ok = f[(f.end_ns > f.start_ns) & (f.start_ns > done)]
            pending += [(int(t), 1) for t in ok.start_ns] + [(int(t), -1) for t in ok.end_ns]
        mark = state.getCurrentWatermarkMs() * 1_000_000
        pending.sort(key=lambda p: (p[0], p[1]))
        rows, k = [], 0
        while k < len(pending) and pending[k][0] <= mark:
            at = pending[k][0]
            while k < len(pending) and pending[k][0] == at:
                level += pending[k][1]
                k += 1
            rows.append((key[0], at, level))
            done = at
        pending = pending[k:]
        state.update((pending, level, done))
        if pending:
            state.setTimeoutTimestamp(max(mark // 1_000_000 + 1, pending[0][0] // 1_000_000 + 1))
        yield pd.DataFrame(rows, columns=["lane", "at_ns", "in_flight"])

    cols = stream.withWatermark("event_time", delay).select(F.col(lane).cast("string").alias("lane"), F.col("request_start_ns").alias("start_ns"), F.col("request_end_ns").alias("end_ns"), "event_time").where("start_ns is not null and end_ns is not null")
    return cols.groupBy("lane").applyInPandasWithState(step, LOAD, HELD, "append", GroupStateTimeout.EventTimeTimeout)
