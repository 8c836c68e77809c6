"""JSON, JSON Lines and CSV. Compressed files (.gz, .bz2) are read as they are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell import schema
from tidewell.functions.tokens import iso_text, once, parse_timestamp, token_value
from tidewell.operators.records import json_records, merge_last_wins, process
from tidewell.session import written
from tidewell.sources import json_parts, layouts

# CSV column names with a role; the first group marks price data.
PRICE_MARKS = {"open", "high", "low", "close", "volume", "vol"}
PRICE_COLUMNS = ["open", "high", "low", "close", "volume", "vol", "openint"]
KEY_COLUMNS = {"series_id", "timestamp", "ticker", "date"}

_EXTRA = "__beyond_header"
SOURCE = json_parts.SOURCE


def _file() -> Column:
    return F.col("_metadata.file_path").alias(SOURCE)


def read_json(spark: SparkSession, path: str | list[str], record_type: str = "time_series") -> DataFrame:
    """A file holds an array of records, one record, or one record per line.

    The first ``}`` of each file tells which. Arrays and objects over several lines are cut into their elements,
    by all tasks that read a part of the file; a broken element is a reject with its text, and those
    behind it are still read. What looked like an object and is none is read by lines. Other values than records
    yield no record, single elements that are none are rejects. An element may have 128 MiB. In a folder that
    mixes layouts, the files are told apart by a join on their names, and a line may have 2 GB.
    """
    pieces = json_parts.read_pieces(spark, path)
    kinds = written(json_parts.kinds_of(pieces), "json_kinds")
    present = {r["kind"] for r in kinds.select("kind").distinct().collect()}
    whole = kinds.where(F.col("kind").isin("array", "object"))
    by_line = kinds.where(F.col("kind") == "lines")
    if not present & {"array", "object"}:
        return read_jsonl(spark, path, record_type) if present <= {"lines"} else _lines_of(spark, path, by_line, record_type)
    found = written(json_parts.elements(pieces.join(whole, SOURCE)), "json_elements")
    no_object = (F.col("kind") == "object") & F.col("broken")
    values = written(json_parts.values_of(found.where(~no_object)), "json_values")
    bad = values.where("record IS NULL AND value IS NOT NULL").select(SOURCE, "value")
    out = process(values.where("value IS NULL").select(SOURCE, "record"), record_type)
    out = out.unionByName(_from_lines(bad, record_type))
    if "object" not in present and "lines" not in present:
        return out
    lost = found.where(no_object).select(SOURCE).distinct()
    return out.unionByName(_lines_of(spark, path, by_line.select(SOURCE).union(lost), record_type))


def _lines_of(spark: SparkSession, path: str | list[str], files: DataFrame, record_type: str) -> DataFrame:
    lines = spark.read.text(path).select("value", _file()).join(files.select(SOURCE), SOURCE, "left_semi")
    return _from_lines(lines.where(F.length(F.trim("value")) > 0), record_type)


def read_jsonl(spark: SparkSession, path: str | list[str], record_type: str = "time_series") -> DataFrame:
    """One record per line; blank lines are skipped, unreadable ones become rejects."""
    lines = spark.read.text(path).select(F.col("value"), _file())
    return _from_lines(lines.where(F.length(F.trim("value")) > 0), record_type)


def _from_lines(lines: DataFrame, record_type: str) -> DataFrame:
    read = json_records(lines).withColumn("__unreadable", F.col("record").isNull())
    done = process(read, record_type)
    unreadable = F.when(F.col("__unreadable"), F.lit("Invalid JSON"))
    return done.withColumn("error", F.coalesce(unreadable, "error")).drop("value", "__unreadable")


@dataclass
class Roles:
    """Columns of a flat table by what they mean: positions of series, time and format, and named measurements."""

    series: int | None
    time: int | None
    format: int | None
    prices: dict[str, int]
    others: dict[str, int]


def roles_of(names: list[str]) -> Roles:
    """``ticker`` names the series before ``series_id``; ``timestamp`` goes before ``date``. Of equal names the last counts.

    In a table with price names these become measurements under their lower-case names, ``volume`` as ``vol``;
    every other column that is no key is a measurement.
    """
    place = {n: i for i, n in enumerate(names)}
    is_price_table = any(n.lower() in PRICE_MARKS for n in place)
    prices, others = {}, {}
    for n, i in place.items():
        if is_price_table and n.lower() in PRICE_COLUMNS:
            key = "vol" if n.lower() == "volume" else n.lower()
            if key not in prices or n.lower() != "volume":
                prices[key] = i
        elif n.lower() not in KEY_COLUMNS:
            others[n] = i
    first = lambda *tries: next((place[n] for n in tries if n in place), None)
    return Roles(first("ticker", "series_id"), first("timestamp", "date"), first("format"), prices, others)


_ROLES = pa.struct(
    [("names", pa.list_(pa.string())), ("width", pa.int32()), ("series", pa.int32()), ("time", pa.int32()), ("format", pa.int32()),
     ("prices", layouts.NAMED), ("others", layouts.NAMED)]
)
_ROLES_SQL = (
    f"names array<string>, width int, series int, time int, format int, prices {layouts.NAMED_SQL}, others {layouts.NAMED_SQL}"
)


def _header_layout(separator: str) -> Callable[[str], dict]:
    def read(first: str) -> dict:
        names = layouts.fields_of(first, separator)
        r = roles_of(names)
        return {
            "names": names, "width": len(names), "series": r.series, "time": r.time, "format": r.format,
            "prices": layouts.named(r.prices), "others": layouts.named(r.others),
        }

    return read


def read_csv(spark: SparkSession, path: str | list[str], header: bool = True, sep: str = ",") -> DataFrame:
    """CSV to canonical columns and ``error``. All cells are read as text, with no type guess.

    Files may differ in their headers: each is read by its own. One header for all is read by Spark's CSV
    source; otherwise the layouts are joined to the lines, as data, however many there are.
    """
    if not header:
        return _read_headerless(spark, path, sep)
    lines = layouts.lines_of(spark, path)
    known = layouts.described(layouts.first_lines(lines), _header_layout(sep), _ROLES, _ROLES_SQL)
    one = layouts.only_one(known)
    return _read_csv(spark, path, list(one["names"]), sep) if one else _placed_csv(lines, known, sep)


def _read_csv(spark: SparkSession, path: str | list[str], names: list[str], sep: str) -> DataFrame:
    fields = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    rows = spark.read.schema(fields).option("header", True).option("sep", sep).csv(path).select("*", _file())
    overlong = F.when(F.col(f"c{len(names)}").isNotNull(), F.lit("Row is longer than the header"))
    place = {n: f"c{i}" for i, n in enumerate(names)}
    return canonical_table(rows.withColumn("error", overlong), names, column=lambda n: F.col(place[n]))


def _placed_csv(lines: DataFrame, known: DataFrame, sep: str) -> DataFrame:
    rows = layouts.with_cells(lines, known, sep)
    raw_time = F.coalesce(layouts.cell("cells", "layout.time"), F.lit(""))
    series = F.when(F.col("layout.series").isNull(), "UNKNOWN").otherwise(F.coalesce(layouts.cell("cells", "layout.series"), F.lit("")))
    # an empty cell stays as an entry without value: validation reports it
    others = layouts.placed("layout.others", "cells", keep_empty=True)
    columns = {
        "error": F.when(layouts.cell("cells", "layout.width").isNotNull(), F.lit("Row is longer than the header")),
        "series_id": series,
        "timestamp": parse_timestamp(raw_time),
        "timestamp_raw": raw_time,
        "measurements": merge_last_wins(others, layouts.placed("layout.prices", "cells")),
        "metadata": F.lit(None).cast(schema.METADATA),
        "format": layouts.cell("cells", "layout.format"),
    }
    return once(rows, columns).select(SOURCE, *columns)


def canonical_table(
    rows: DataFrame,
    names: list[str],
    cell: Callable[[str], Column] | None = None,
    column: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Flat columns to canonical columns by ``roles_of`` their names.

    ``column`` finds the column of a name; ``cell`` gives its VALUE, by default from text.
    """
    column = column or (lambda n: F.col(f"`{n}`"))
    cell = cell or (lambda n: token_value(column(n)))
    roles = roles_of(names)
    series = F.lit("UNKNOWN") if roles.series is None else column(names[roles.series])
    raw_time = F.lit("") if roles.time is None else column(names[roles.time])
    if roles.time is not None and not isinstance(rows.select(raw_time).schema[0].dataType, StringType):
        at = raw_time.cast("timestamp")
        raw_time = iso_text(at)
    else:
        at = parse_timestamp(raw_time)
    prices = {key: cell(names[i]) for key, i in roles.prices.items()}
    # an empty cell stays as an entry without value: validation reports it
    entries = [F.struct(F.lit(n).alias("key"), cell(n).alias("value")) for n in roles.others]
    kept = F.map_from_entries(F.array(*entries)) if entries else F.create_map().cast(schema.MEASUREMENTS)
    measurements = merge_last_wins(kept, schema.measurement_map(prices)) if prices else kept
    columns = {
        "series_id": F.coalesce(series.cast("string"), F.lit("")),
        "timestamp": at,
        "timestamp_raw": F.coalesce(raw_time, F.lit("")),
        "measurements": measurements,
        "metadata": F.lit(None).cast(schema.METADATA),
        "format": F.lit(None).cast("string") if roles.format is None else column(names[roles.format]),
    }
    plain = rows.select(
        *[c for c in (SOURCE, "error") if c in rows.columns], F.struct(*[c.alias(n) for n, c in columns.items()]).alias("__row")
    )
    return once(plain, {"__row": F.col("__row")}).select(*[c for c in plain.columns if c != "__row"], "__row.*")


def _read_headerless(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """First column series, second time, the rest ``measurement_0...n``.

    The widest line decides the number of columns, so one pass counts separators first.
    """
    gaps = F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit("")))
    widest = spark.read.text(path).agg(F.max(gaps).alias("n")).first()["n"] or 0
    n = max(widest + 1, 2)
    fields = ", ".join(f"c{i} string" for i in range(n))
    rows = spark.read.schema(fields).option("sep", sep).csv(path).select("*", _file())
    values = {f"measurement_{i - 2}": token_value(F.col(f"c{i}")) for i in range(2, n)}
    return rows.where(F.col("c1").isNotNull()).select(
        SOURCE,
        F.lit(None).cast("string").alias("error"),
        F.col("c0").alias("series_id"),
        parse_timestamp(F.col("c1")).alias("timestamp"),
        F.col("c1").alias("timestamp_raw"),
        (schema.measurement_map(values) if values else F.create_map().cast(schema.MEASUREMENTS)).alias("measurements"),
        F.lit(None).cast(schema.METADATA).alias("metadata"),
        F.lit(None).cast("string").alias("format"),
    )
