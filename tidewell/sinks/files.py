"""Writing records to files. Every sink writes a directory of part files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewell.operators.reshape import flatten, sorted_columns
from tidewell.sinks import protocols
from tidewell.sources import arrow_ipc

# Codecs a text sink accepts, by format name.
TEXT_CODECS = {"gzip": "gzip", "bzip2": "bzip2"}


class NothingToWrite(ValueError):
    pass


def _flat(df: DataFrame, keys: Sequence[str] | None, text: bool) -> DataFrame:
    """Flattened with sorted columns; text sinks print the source tokens."""
    if "measurements" not in df.columns:
        return sorted_columns(df)
    out = flatten(df, keys, kind="raw" if text else None)
    if text and "metadata" in out.columns:
        out = out.withColumn("metadata", F.to_json("metadata"))
    return sorted_columns(out)


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON Lines. Numbers print as their source token, text as text."""
    out = df
    if "measurements" in df.columns:
        out = df.withColumn("measurements", F.transform_values("measurements", lambda _, v: protocols.token(v)))
    out.write.option("compression", compression).json(path)


def write_csv(
    df: DataFrame, path: str, sep: str = ",", keys: Sequence[str] | None = None, compression: str = "none"
) -> None:
    """Flattened, with a sorted header; missing values are empty."""
    (
        _flat(df, keys, True)
        .write.option("header", True)
        .option("sep", sep)
        .option("compression", compression)
        .csv(path)
    )


def write_txt(df: DataFrame, path: str, sep: str = "\t", **options) -> None:
    write_csv(df, path, sep, **options)


def write_parquet(df: DataFrame, path: str, keys: Sequence[str] | None = None, codec: str = "snappy") -> None:
    _flat(df, keys, False).write.option("compression", codec).parquet(path)


def write_orc(df: DataFrame, path: str, keys: Sequence[str] | None = None) -> None:
    _flat(df, keys, False).write.orc(path)


def write_arrow(df: DataFrame, path: str, keys: Sequence[str] | None = None) -> None:
    arrow_ipc.register(df.sparkSession)
    _flat(df, keys, False).write.format("arrow_ipc").mode("append").save(path)


def write_stooq(df: DataFrame, path: str) -> None:
    protocols.stooq_rows(df).write.option("header", True).csv(path)


def _lines(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str], None]:
    return lambda df, path: make(df).write.text(path)


def _json_rows(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str], None]:
    return lambda df, path: make(df).write.json(path)


def write_timescale(df: DataFrame, path: str, table: str = "time_series_data") -> None:
    """The table definition and the inserts, side by side."""
    ddl = [(line,) for line in protocols.timescale_ddl(table)]
    df.sparkSession.createDataFrame(ddl, "value string").coalesce(1).write.text(f"{path}/ddl")
    protocols.timescale_lines(df, table).write.text(f"{path}/rows")


WRITERS: dict[str, Callable] = {
    "json": write_json,
    "jsonl": write_json,
    "csv": write_csv,
    "txt": write_txt,
    "parquet": write_parquet,
    "orc": write_orc,
    "arrow": write_arrow,
    "feather": write_arrow,
    "stooq": write_stooq,
    "influxdb": _lines(protocols.line_protocol),
    "opentsdb": _lines(protocols.opentsdb_lines),
    "questdb": _lines(protocols.questdb_lines),
    "tdengine": _lines(protocols.tdengine_lines),
    "timescaledb": write_timescale,
    "prometheus": _json_rows(protocols.prometheus_rows),
    "protobuf": _json_rows(protocols.protobuf_rows),
    "tsfile": _json_rows(protocols.tsfile_rows),
    "victoriametrics": _json_rows(protocols.victoria_rows),
    "gzip": lambda df, path, inner="json": _compressed(df, path, inner, "gzip"),
    "bzip2": lambda df, path, inner="json": _compressed(df, path, inner, "bzip2"),
}


def _compressed(df: DataFrame, path: str, inner: str, codec: str) -> None:
    if inner not in ("json", "jsonl", "csv", "txt"):
        raise NotImplementedError(f"{inner} is not written as compressed text")
    WRITERS[inner](df, path, compression=TEXT_CODECS[codec])


def write_records(df: DataFrame, path: str, fmt: str, **options) -> int:
    """Write and return the number of records, counted in the same pass; empty input is refused."""
    fmt = fmt.lower()
    if fmt not in WRITERS:
        raise NotImplementedError(f"{fmt} files cannot be written")
    if df.isEmpty():
        raise NothingToWrite("no records to write")
    seen = Observation()
    WRITERS[fmt](df.observe(seen, F.count(F.lit(1)).alias("n")), path, **options)
    return seen.get["n"]
