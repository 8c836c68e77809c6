"""Event-time windows, deduplication and rate limits over streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.duplicates import remove_duplicates
from tidewell.session import work_path


def hourly_activity(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Records and (approximately counted) distinct series per hour."""
    return (
        events.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", "1 hour").alias("w"))
        .agg(F.count("*").alias("records"), F.approx_count_distinct("series_id").alias("series"))
        .select(F.col("w.start").alias("hour"), "records", "series")
    )


def tumbling(
    events: DataFrame, width: str, aggregates: Sequence, by: Sequence[str] = ("series_id",), late: str = "1 hour"
) -> DataFrame:
    """Resampling without empty bins, which a stream cannot emit; fill them when reading."""
    return (
        events.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", width).alias("w"), *by)
        .agg(*aggregates)
        .withColumn("timestamp", F.col("w.start"))
        .drop("w")
    )


def first_deliveries(events: DataFrame, late: str = "1 hour", keys=("series_id", "timestamp")) -> DataFrame:
    """Drop repeats of a key that arrive within the watermark; later corrections go through the store."""
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(list(keys))


def quiet_gap_limit(events: DataFrame, key: str, limit: int, window: int, late: str = "1 hour") -> DataFrame:
    """Allowed and denied events per session; a session ends after ``window`` quiet seconds."""
    sessions = (
        events.withWatermark("timestamp", late)
        .groupBy(F.session_window("timestamp", f"{window} seconds").alias("s"), key)
        .agg(F.count("*").alias("n"))
    )
    return sessions.select(
        key,
        F.col("s.start").alias("session_start"),
        F.least("n", F.lit(limit)).cast("long").alias("allowed"),
        F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("denied"),
    )


def fixed_window_limit(
    events: DataFrame, key: str, order: str, limit: int, window: int, late: str = "1 hour"
) -> DataFrame:
    """A window opens with a key's first event; the first ``limit`` events in it are allowed.

    State per key is one window start and one count, dropped once the watermark has passed
    the window. Within a micro-batch a key's events are taken in time order; the batch size is
    bounded by the source's trigger options.
    """
    width = window * 1_000_000
    schema = events.schema

    def step(ids: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["__us", order])
        starts, allowed, remaining = [], [], []
        for at in rows["__us"]:
            if opened is None or at >= opened + width:
                opened, used = int(at), 0
            used += 1
            starts.append(opened)
            allowed.append(used <= limit)
            remaining.append(max(limit - used, 0))
        state.update((opened, used))
        state.setTimeoutTimestamp(max((opened + width) // 1000, state.getCurrentWatermarkMs()) + 1)
        out = rows[[key, order]].copy()
        out["window_us"], out["allowed"], out["remaining"] = starts, allowed, remaining
        yield out

    kinds = {n: schema[n].dataType.simpleString() for n in (key, order)}
    placed = events.withWatermark("timestamp", late).select(
        key, order, "timestamp", F.unix_micros("timestamp").alias("__us")
    )
    decided = placed.groupBy(key).applyInPandasWithState(
        step,
        outputStructType=f"{key} {kinds[key]}, {order} {kinds[order]}, window_us long, allowed boolean, remaining long",
        stateStructType="opened long, used long",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    return decided.withColumn("window_start", F.timestamp_micros("window_us")).drop("window_us")


def write_updates(result: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Each batch goes to its own folder, so a repeated batch overwrites itself."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    return (
        result.writeStream.outputMode(mode)
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last state of every key that ``write_updates`` has seen."""
    seen = spark.read.parquet(path).drop("batch")
    return remove_duplicates(seen, list(keys), "last", ["batch_id"]).drop("batch_id")


def run_now(spark: SparkSession, result: DataFrame, keys: Sequence[str] = (), mode: str = "update") -> DataFrame:
    """Run a stream over what its source holds and return the result table."""
    path = work_path(spark, "stream")
    write_updates(result, f"{path}/out", f"{path}/checkpoint", mode).awaitTermination()
    if keys:
        return latest_updates(spark, f"{path}/out", keys)
    return spark.read.parquet(f"{path}/out").drop("batch", "batch_id")
