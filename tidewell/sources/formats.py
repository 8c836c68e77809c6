"""File formats by extension and name, and what this library reads and writes of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import schema
from tidewell.functions.tokens import iso_text
from tidewell.sources import arrow_ipc, protocols, text
from tidewell.sources.delimited import read_delimited
from tidewell.sources.stooq import read_stooq

# File extension to format name.
EXTENSIONS = {
    ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".txt": "txt",
    ".parquet": "parquet", ".pq": "parquet", ".feather": "feather", ".arrow": "arrow",
    ".h5": "h5", ".hdf5": "h5", ".duckdb": "duckdb", ".sqlite": "sqlite", ".db": "sqlite",
    ".xlsx": "xlsx", ".xls": "xls", ".avro": "avro", ".orc": "orc", ".msgpack": "msgpack",
    ".mp": "msgpack", ".lp": "influxdb", ".tsdb": "opentsdb", ".prom": "prometheus",
    ".gz": "gzip", ".bz2": "bzip2", ".zst": "zstandard", ".zstd": "zstandard", ".zip": "zip",
    ".tar": "tar", ".nc": "netcdf", ".netcdf": "netcdf", ".cdf": "netcdf", ".zarr": "zarr",
    ".fits": "fits", ".fit": "fits", ".tsfile": "tsfile", ".td": "tdengine",
    ".vm": "victoriametrics", ".pb": "protobuf", ".protobuf": "protobuf",
    ".sql": "timescaledb", ".ilp": "questdb",
}

# Format name to extension and media type.
FORMATS = {
    "json": (".json", "application/json"),
    "jsonl": (".jsonl", "application/x-ndjson"),
    "csv": (".csv", "text/csv"),
    "txt": (".txt", "text/plain"),
    "parquet": (".parquet", "application/octet-stream"),
    "feather": (".feather", "application/octet-stream"),
    "duckdb": (".duckdb", "application/octet-stream"),
    "xlsx": (".xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    "xls": (".xls", "application/vnd.ms-excel"),
    "h5": (".h5", "application/x-hdf"),
    "arrow": (".arrow", "application/octet-stream"),
    "avro": (".avro", "application/avro"),
    "orc": (".orc", "application/octet-stream"),
    "msgpack": (".msgpack", "application/x-msgpack"),
    "sqlite": (".sqlite", "application/x-sqlite3"),
    "influxdb": (".lp", "text/plain"),
    "protobuf": (".pb", "application/x-protobuf"),
    "opentsdb": (".tsdb", "text/plain"),
    "prometheus": (".prom", "application/x-protobuf"),
    "gzip": (".gz", "application/gzip"),
    "bzip2": (".bz2", "application/x-bzip2"),
    "zstandard": (".zst", "application/zstd"),
    "zip": (".zip", "application/zip"),
    "tar": (".tar", "application/x-tar"),
    "netcdf": (".nc", "application/netcdf"),
    "zarr": (".zarr", "application/zarr"),
    "fits": (".fits", "application/fits"),
    "tsfile": (".tsfile", "application/octet-stream"),
    "tdengine": (".td", "text/plain"),
    "victoriametrics": (".vm", "application/json"),
    "timescaledb": (".sql", "application/sql"),
    "questdb": (".ilp", "text/plain"),
    "stooq": (".txt", "text/csv"),
}

# Format names by category.
CATEGORIES = {
    "text": ["json", "jsonl", "csv", "txt"],
    "binary": ["parquet", "feather", "arrow", "h5"],
    "database": ["duckdb", "sqlite"],
    "excel": ["xlsx", "xls"],
    "specialized": ["avro", "orc", "msgpack", "protobuf"],
    "tsdb": ["influxdb", "opentsdb", "prometheus"],
    "compression": ["gzip", "bzip2", "zstandard"],
    "scientific": ["netcdf", "zarr", "fits"],
    "specialized_ts": ["tsfile", "tdengine", "victoriametrics"],
}


def detect_format(path: str) -> str | None:
    """Format name by extension; compressed text counts as what it holds."""
    name = PurePosixPath(path)
    found = EXTENSIONS.get(name.suffix.lower())
    if found in ("gzip", "bzip2"):
        return EXTENSIONS.get(PurePosixPath(name.stem).suffix.lower(), found)
    return found


def format_of(path: Column) -> Column:
    """``detect_format`` for a column of paths."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    last = lambda p: F.lower(F.regexp_extract(p, r"[^/.][^/]*(\.[^./]+)$", 1))
    found = F.try_element_at(known, last(path))
    inner = F.try_element_at(known, last(F.regexp_replace(path, r"\.[^./]*$", "")))
    return F.when(found.isin("gzip", "bzip2"), F.coalesce(inner, found)).otherwise(found)


def _columnar(reader: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, path: str) -> DataFrame:
        # files may differ in columns; what one lacks is null
        rows = spark.read.format(reader).option("mergeSchema", True).load(path)
        return flat_records(rows.select("*", F.col("_metadata.file_path").alias(text.SOURCE)))

    return read


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    return flat_records(arrow_ipc.read(spark, path))


def flat_records(df: DataFrame) -> DataFrame:
    """A typed table to canonical columns: canonical ones as they are, flat ones like CSV."""
    if "measurements" in df.columns and "series_id" in df.columns:
        out = df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))
        if "timestamp_raw" not in out.columns:
            out = out.withColumn("timestamp_raw", F.col("timestamp").cast("string"))
        return out
    plain = df.withColumnsRenamed({c: c.removeprefix("measurement_") for c in df.columns})
    names = [c for c in plain.columns if c != text.SOURCE]

    def cell(name: str) -> Column:
        kind, c = plain.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            value = schema.number_value(c)
        elif isinstance(kind, T.TimestampType):
            value = schema.text_value(iso_text(c))
        else:
            value = schema.text_value(c)
        return F.when(c.isNotNull(), value)

    return text.canonical_table(plain.withColumn("error", F.lit(None).cast("string")), names, cell)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "json": text.read_json,
    "jsonl": text.read_jsonl,
    "csv": text.read_csv,
    "txt": read_delimited,
    "stooq": read_stooq,
    "parquet": _columnar("parquet"),
    "orc": _columnar("orc"),
    "feather": read_arrow,
    "arrow": read_arrow,
    "influxdb": protocols.read_line_protocol,
    "opentsdb": protocols.read_opentsdb,
    "prometheus": protocols.prometheus_records,
    "questdb": protocols.read_line_protocol,
}


def read_records(spark: SparkSession, path: str | list[str], fmt: str | None = None) -> DataFrame:
    """Canonical columns and ``error`` from any readable format; unknown extensions read as JSON.

    The paths of one format are one read, not a loop; without ``fmt`` each path has the format of its extension.
    """
    groups: dict[str, list[str]] = {}
    for own in [path] if isinstance(path, str) else path:
        groups.setdefault((fmt or detect_format(own) or "json").lower(), []).append(own)
    for name in groups:
        if name not in READERS:
            raise NotImplementedError(f"{name} files cannot be read")
    if len(groups) == 1:
        return READERS[next(iter(groups))](spark, path)
    parts = [READERS[name](spark, own) for name, own in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
