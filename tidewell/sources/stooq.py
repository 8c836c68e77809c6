"""Stooq price files: TICKER, PER, DATE, TIME, OPEN, HIGH, LOW, CLOSE, VOL, OPENINT."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import schema
from tidewell.functions.tokens import iso_text, once, parse_loose
from tidewell.sources import layouts

# The columns of the format, in file order.
STOOQ_COLUMNS = ["TICKER", "PER", "DATE", "TIME", "OPEN", "HIGH", "LOW", "CLOSE", "VOL", "OPENINT"]


_PLACES = pa.struct([("width", pa.int32()), ("places", pa.list_(pa.int32()))])


def _layout(first: str) -> dict:
    names = layouts.fields_of(first, ",")
    return {"width": len(names), "places": [names.index(c) if c in names else None for c in STOOQ_COLUMNS]}


def read_stooq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Canonical columns and ``error``; a bad number drops that field only. Each file has its own header."""
    return stooq_lines(layouts.lines_of(spark, path))


def stooq_lines(lines: DataFrame) -> DataFrame:
    known = layouts.described(layouts.first_lines(lines), _layout, _PLACES, "width int, places array<int>")
    rows = layouts.with_cells(lines, known, ",")
    cells = [F.trim(F.get("cells", F.get("layout.places", F.lit(i)))).alias(c) for i, c in enumerate(STOOQ_COLUMNS)]
    return stooq_records(rows.select(layouts.SOURCE, *cells))


def stooq_records(rows: DataFrame) -> DataFrame:
    clock = F.when(F.length("TIME") == 6, F.col("TIME")).otherwise("000000")
    timed = once(rows, {"__at": F.when(F.length("DATE") == 8, parse_loose(F.concat("DATE", clock)))})
    values: dict[str, Column] = {
        c.lower(): schema.number_value(F.col(c).try_cast("double")) for c in ("OPEN", "HIGH", "LOW", "CLOSE")
    }
    for c in ("VOL", "OPENINT"):
        values[c.lower()] = schema.number_value(F.col(c).try_cast("double").try_cast("bigint"))
    period = F.nullif(F.col("PER"), F.lit(""))
    values["period"] = schema.text_value(period)
    ticker = F.coalesce(F.col("TICKER"), F.lit(""))
    error = F.when(ticker == "", "Missing ticker").when(F.col("__at").isNull(), "Invalid date or time")
    kept = [c for c in rows.columns if c not in STOOQ_COLUMNS]
    columns = {
        "error": error,
        "series_id": ticker,
        "timestamp": F.col("__at"),
        "timestamp_raw": iso_text(F.col("__at")),
        "measurements": schema.measurement_map(values),
        "metadata": schema.string_map({"format": F.lit("stooq"), "ticker": ticker, "period": period}),
        "format": F.lit("stooq"),
    }
    return once(timed, columns).select(*kept, *columns)
