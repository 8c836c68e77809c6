"""Incremental ingest and message fan-out. State lives in checkpoints and in the store."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators import records, store
from tidewell.session import written
from tidewell.sources.formats import READERS, detect_format, read_records
from tidewell.sources.layouts import SOURCE

REJECT_COLUMNS = ["value", "error"]


def ingest(
    spark: SparkSession,
    landing: str,
    store_path: str,
    rejects_path: str,
    checkpoint: str,
    record_type: str = "time_series",
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Validate every JSON Lines file that lands and merge it into the store.

    A repeated batch writes the same rows again: accepted rows by key, rejects into the
    folder of their batch. The trigger takes what is there and stops.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(landing)
        .select("value", F.col("_metadata.file_modification_time").alias("file_time"))
        .where(F.length(F.trim("value")) > 0)
    )

    def merge(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("line_id", F.monotonically_increasing_id()).withColumn(
            "batch_id", F.lit(batch_id)
        )
        read = records.json_records(numbered).withColumn("unreadable", F.col("record").isNull())
        done = records.process(read, record_type)
        unreadable = F.when(F.col("unreadable"), F.lit("Invalid JSON"))
        # accepted and rejected are two actions over one parse
        checked = done.withColumn("error", F.coalesce(unreadable, "error")).drop("unreadable").persist()
        parts = records.split(checked)
        parts.rejected.select(*REJECT_COLUMNS).write.mode("overwrite").parquet(
            f"{rejects_path}/batch={batch_id}"
        )
        store.upsert(
            batch.sparkSession, store_path, parts.accepted.drop("value"),
            ["batch_id", "file_time", "line_id"],
        )
        checked.unpersist()

    return (
        lines.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_LANDED = "path string, modificationTime timestamp, length long, content binary"
REJECTED = [SOURCE, "series_id", "timestamp_raw", "error"]


def _literal(path: str) -> str:
    """A path whose glob marks are taken as they are."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def ingest_files(
    spark: SparkSession,
    landing: str,
    store_path: str,
    rejects_path: str,
    checkpoint: str,
    fmt: str | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Validate every file that lands, of any readable format, and merge it into the store.

    The stream carries the names of files only. Those of a batch, at most ``files_per_batch``, are grouped by
    ``fmt`` or by their extension, and each group is one read with all its layouts. Files of a format
    that cannot be read are one reject each. A repeated batch writes the same rows again. Among the rows of
    one key the newer file wins. The trigger takes what is there and stops.
    """
    names = spark.readStream.format("binaryFile").schema(_LANDED).option("maxFilesPerTrigger", files_per_batch).load(landing)
    names = names.select("path", "modificationTime", F.col("_metadata.file_path").alias(SOURCE))

    def merge(batch: DataFrame, batch_id: int) -> None:
        own, landed = batch.sparkSession, batch.collect()
        readable = [f for f in landed if (fmt or detect_format(f["path"]) or "json") in READERS]
        others = [(f[SOURCE], None, None, "Files of this format cannot be read") for f in landed if f not in readable]
        lost = own.createDataFrame(others, ", ".join(f"{c} string" for c in REJECTED))
        folder = f"{rejects_path}/batch={batch_id}"
        if not readable:
            lost.write.mode("overwrite").parquet(folder)
            return
        read = read_records(own, [_literal(f["path"]) for f in readable], fmt)
        times = own.createDataFrame([(f[SOURCE], f["modificationTime"]) for f in readable], f"{SOURCE} string, file_time timestamp")
        # accepted and rejected are two actions over one parse
        checked = written(records.check_canonical(read).join(times, SOURCE, "left"), "landed")
        parts = records.split(checked)
        parts.rejected.select(*REJECTED).unionByName(lost).write.mode("overwrite").parquet(folder)
        numbered = parts.accepted.withColumns({"batch_id": F.lit(batch_id), "line_id": F.monotonically_increasing_id()})
        store.upsert(own, store_path, numbered, ["batch_id", "file_time", "line_id"])

    return (
        names.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fan_out(
    messages: DataFrame,
    channel: str,
    handler: Callable[[DataFrame, int], None],
    rejects_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Give each batch of a channel's messages, parsed, to ``handler``; unreadable ones are set aside.

    ``messages`` carries ``channel`` and JSON text ``value``.
    """
    mine = messages.where(F.col("channel") == channel)

    def deliver(batch: DataFrame, batch_id: int) -> None:
        parsed = records.json_records(batch).persist()
        parsed.where(F.col("record").isNull()).drop("record").write.mode("overwrite").parquet(
            f"{rejects_path}/batch={batch_id}"
        )
        handler(parsed.where(F.col("record").isNotNull()), batch_id)
        parsed.unpersist()

    return (
        mine.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
