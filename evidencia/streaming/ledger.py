"""The ledger as a stream: windows of events, and active time with state, over files or any source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import ensure_checkpoint_dir


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", ts: str = "ts", late: str = "1 day", files: int = 16) -> DataFrame:
    """Parquet files as a stream with event time; rows later than `late` behind the newest don't count."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str) -> DataFrame:
    """(window_start, kind, n): events by tumbling window and kind."""
    counted = stream.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n")


def active_time(stream: DataFrame, key: str, ts: str, cap_seconds: int) -> DataFrame:
    """(key, active_us): time between neighbouring events of a key, gaps above the cap left out, kept as state.

    State holds the sum over settled events, the last of them, and the times that the watermark hasn't passed yet, as
    an earlier one may still come before these. Events may come late by the stream's watermark and in any order,
    repeated ones count once, and any split into batches gives the same last row of a key.
    """
    cap = cap_seconds * 1_000_000

    def walked(last: int | None, total: int, times: list[int]) -> tuple[int | None, int]:
        for t in times:
            if last is not None and t - last <= cap:
                total += t - last
            last = t
        return last, total

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, waiting = state.get if state.exists else (None, 0, [])
        new = {int(t.value // 1000) for f in frames for t in pd.to_datetime(f[ts])}
        times = sorted(t for t in {*waiting, *new} if last is None or t > last)
        passed = state.getCurrentWatermarkMs() * 1000
        settled, waiting = [t for t in times if t <= passed], [t for t in times if t > passed]
        last, total = walked(last, total, settled)
        state.update((last, total, waiting))
        yield pd.DataFrame({key: [k[0]], "active_us": [walked(last, total, waiting)[1]]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, ts).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, active_us long", "last long, total long, waiting array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def run_available(df: DataFrame, name: str, mode: str, **options: str) -> DataFrame:
    """All that is there now, through the stream and into a table in the shared folder; then that table.

    In update mode the last row of each key stands; the caller's keys are all columns but the last. Every run has a
    folder of its own, so none goes on from another's state.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    query = df.writeStream.outputMode(mode).foreachBatch(sink).options(**options).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.parquet(f"{folder}/out")
    keys, value = written.columns[:-2], written.columns[-2]
    return written.groupBy(*keys).agg(F.max_by(value, "__batch").alias(value))
