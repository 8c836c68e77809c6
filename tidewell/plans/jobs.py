"""Batch jobs: conversion, export, transformation, tables and reports over whole data sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import records, steps
from tidewell.operators.profile import source_report
from tidewell.sinks.files import WRITERS, NothingToWrite, write_records
from tidewell.sources.formats import CATEGORIES, FORMATS, READERS, detect_format, format_of, read_records


def supported_formats() -> dict[str, list[str]]:
    """Known format names by category."""
    return {category: [f for f in names if f in FORMATS] for category, names in CATEGORIES.items()}


def can_convert(source: str, target: str) -> bool:
    """Derived from the readers and writers that exist."""
    return source.lower() in READERS and target.lower() in WRITERS


def convertible(path: Column, target: Column) -> Column:
    """``can_convert`` for columns: the format of a path by its extension, and the name of a format to write."""
    readable = F.coalesce(format_of(path).isin(list(READERS)), F.lit(False))
    return readable & F.coalesce(F.lower(target).isin(list(WRITERS)), F.lit(False))


def convert(
    spark: SparkSession, source: str, target: str,
    source_format: str | None = None, target_format: str | None = None, **options,
) -> int:
    """Any readable format to any writable one; bad records stay behind, empty input is refused."""
    read = records.check_canonical(read_records(spark, source, source_format))
    accepted = records.split(read).accepted.drop("source_file")
    fmt = target_format or detect_format(target)
    if fmt is None:
        raise ValueError(f"no format known for {target}")
    return write_records(accepted, target, fmt, **options)


def export(df: DataFrame, path: str, fmt: str) -> int:
    """Batch export of a plain table as csv, json or parquet."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"cannot export as {fmt}")
    return write_records(df, path, fmt)


def csv_to_parquet(
    spark: SparkSession, source: str, target: str, codec: str = "snappy", append: bool = False
) -> int:
    """Streams through the splits; the row count comes from the same pass."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(source)
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    mode = "append" if append else "overwrite"
    counted.write.mode(mode).option("compression", codec).parquet(target)
    return seen.get["n"]


def csv_to_table(
    spark: SparkSession, source: str, table: str = "time_series_data",
    header: bool = True, if_exists: str = "replace",
) -> int:
    modes = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}
    rows = spark.read.option("header", header).option("inferSchema", True).csv(source)
    if rows.isEmpty():
        raise NothingToWrite(f"{source} is empty")
    rows.write.mode(modes[if_exists]).format("parquet").saveAsTable(table)
    return spark.table(table).count()


@dataclass
class TransformReport:
    original_rows: int
    final_rows: int
    steps: int

    @property
    def rows_removed(self) -> int:
        return self.original_rows - self.final_rows


def transform(df: DataFrame, operations: Sequence[Mapping], path: str, fmt: str = "parquet") -> TransformReport:
    """The batch variant of cleaning: an error ends the job. Rows are counted while writing."""
    named = [{**op, "operation": steps.BATCH_STEPS.get(op.get("operation"))} for op in operations]
    before, after = Observation(), Observation()
    one = F.count(F.lit(1)).alias("n")
    cleaned = steps.clean(df.observe(before, one), _filled(named), on_error="raise").df
    cleaned.observe(after, one).write.format(fmt).save(path)
    return TransformReport(before.get["n"], after.get["n"], len(operations))


def _filled(operations: Sequence[dict]) -> list[dict]:
    """``fill_na`` of the batch job takes a bare value."""
    out = []
    for op in operations:
        params = op.get("params", {})
        if op["operation"] == "fill_na" and "value" in params and "method" not in params:
            op = {**op, "params": {**params, "method": "value"}}
        out.append(op)
    return out


def batch_outcomes(spark: SparkSession, paths: Sequence[str], fmt: str) -> DataFrame:
    """Per file total, success and error counts, from one read over all paths."""
    read = read_records(spark, list(paths), fmt)
    return records.outcome_counts(records.check_canonical(read))


def report(sources: Mapping[str, DataFrame]) -> DataFrame:
    return source_report(sources)
