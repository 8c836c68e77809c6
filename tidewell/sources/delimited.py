"""Delimited text whose layout is found by looking at its first two lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell import schema
from tidewell.functions.tokens import iso_text, once, parse_loose, token_value
from tidewell.operators.records import merge_last_wins
from tidewell.sources import layouts
from tidewell.sources.layouts import SOURCE
from tidewell.sources.stooq import stooq_lines

# Separators tried in this order, header names with a role, and period codes.
SEPARATORS = [",", "\t", ";", "|"]
WHITESPACE = r"\s+"
DATE_NAMES = ["DATE", "DATETIME", "TIMESTAMP", "DT"]
SERIES_NAMES = ["TICKER", "SYMBOL", "SERIES", "SERIES_ID", "ID", "NAME"]
PRICE_NAMES = {
    "open": ["OPEN", "O"],
    "high": ["HIGH", "H"],
    "low": ["LOW", "L"],
    "close": ["CLOSE", "C", "ADJ CLOSE", "ADJ_CLOSE", "ADJCLOSE"],
    "vol": ["VOLUME", "VOL", "V"],
}
PERIODS = ["D", "W", "M", "5", "15", "30", "60"]


@dataclass
class Layout:
    """How to cut a line (a regular expression) and what each field means."""

    separator: str
    header: str | None = None
    names: list[str] | None = None
    date: int | None = None
    series: int | None = None
    prices: dict[str, int] = field(default_factory=dict)
    stooq: bool = False


def pick_separator(line: str) -> str:
    """The separator giving most non-empty fields; runs of blanks when none gives two."""
    counts = [sum(1 for p in line.split(s) if p.strip()) for s in SEPARATORS]
    best = max(counts)
    if best <= 1 and len(line.split()) > best:
        return WHITESPACE
    return re.escape(SEPARATORS[counts.index(best)] if best else "\t")


def _index_of(names: list[str], wanted: list[str]) -> int | None:
    return next((i for i, n in enumerate(names) if n in wanted), None)


def find_layout(first: str, second: str | None = None, separator: str | None = None) -> Layout:
    upper = [p.strip().upper() for p in first.split(",")]
    if "," in first and "TICKER" in upper and ("DATE" in upper or "PER" in upper):
        return Layout(",", header=first, stooq=True)
    cut = re.escape(separator) if separator else pick_separator(first)
    fields = re.split(cut, first)
    if not any(ch.isalpha() for ch in fields[0]):
        return Layout(cut)
    names = [f.strip().strip("<>") for f in fields]
    roles = [n.upper() for n in names]
    if second is not None and "TICKER" in roles:
        data = re.split(cut, second)
        if len(data) == len(names) + 1 and data[1].strip() in PERIODS:
            names.insert(1, "PER")
            roles.insert(1, "PER")
    prices = {}
    for i, role in enumerate(roles):
        prices.update({k: i for k, spellings in PRICE_NAMES.items() if role in spellings})
    return Layout(cut, first, names, _index_of(roles, DATE_NAMES), _index_of(roles, SERIES_NAMES), prices)


_LAYOUT = pa.struct(
    [("separator", pa.string()), ("header", pa.string()), ("names", pa.list_(pa.string())), ("date", pa.int32()),
     ("series", pa.int32()), ("prices", layouts.NAMED), ("others", layouts.NAMED), ("stooq", pa.bool_())]
)
_LAYOUT_SQL = (
    "separator string, header string, names array<string>, date int, series int, "
    f"prices {layouts.NAMED_SQL}, others {layouts.NAMED_SQL}, stooq boolean"
)


def _described(separator: str | None):
    def read(first: str, second: str | None) -> dict:
        found = find_layout(first, second, separator)
        used = {found.date, found.series, *found.prices.values()}
        others = {n.lower().replace(" ", "_"): i for i, n in enumerate(found.names or []) if i not in used}
        return {
            "separator": found.separator, "header": found.header, "names": found.names, "date": found.date, "series": found.series,
            "prices": layouts.named(found.prices), "others": layouts.named(others), "stooq": found.stooq,
        }

    return read


def read_delimited(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """Canonical columns and ``error``. Each file is read by the layout that its first two lines show.

    One layout for all is a plan of its own; several are joined to the lines as data. Files of the price
    format, and those without a date, whose lines are numbered, are parts of the plan for themselves.
    """
    lines = layouts.lines_of(spark, path, trimmed=True)
    known = layouts.described(layouts.first_lines(lines, 2), _described(separator), _LAYOUT, _LAYOUT_SQL)
    kinds = known.select("layout.stooq", F.col("layout.date").isNull().alias("undated")).distinct().collect()
    if not kinds:
        return _empty(lines)
    one = layouts.only_one(known)
    if one and not one["stooq"]:
        places = {k: {p["name"]: p["at"] for p in one[k]} for k in ("prices",)}
        return _of_layout(lines, spark, path, Layout(one["separator"], one["header"], one["names"], one["date"], one["series"], places["prices"]))
    parts = []
    if any(k["stooq"] for k in kinds):
        parts.append(stooq_lines(lines.join(known.where("layout.stooq").select(SOURCE), SOURCE, "left_semi")))
    plain = known.where("NOT layout.stooq")
    if any(not k["stooq"] and not k["undated"] for k in kinds):
        parts.append(_placed(lines.join(plain.where("layout.date IS NOT NULL"), SOURCE)))
    if any(not k["stooq"] and k["undated"] for k in kinds):
        parts.append(_placed(_numbered(_raw_lines(spark, path)).join(plain.where("layout.date IS NULL"), SOURCE)))
    return reduce(DataFrame.unionByName, parts)


def _raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines, blank ones too: they count in the numbers of lines."""
    return spark.read.text(path).select(
        F.trim("value").alias("line"),
        F.col("_metadata.file_path").alias(SOURCE),
        F.col("_metadata.file_name").alias("__name"),
        F.col("_metadata.file_block_start").alias("__block"),
    )


def _of_layout(lines: DataFrame, spark: SparkSession, path: str | list[str], layout: Layout) -> DataFrame:
    rows = lines if layout.date is not None else _numbered(_raw_lines(spark, path)).where(F.length("line") > 0)
    if layout.header:
        rows = rows.where(F.col("line") != F.lit(layout.header))
    return _canonical(rows.withColumn("p", F.split("line", layout.separator)), layout)


def _placed(rows: DataFrame) -> DataFrame:
    """Lines with their ``layout`` to canonical columns."""
    # the few separators there are stay constants of the plan
    pattern, own = F.col("layout.separator"), F.split("line", WHITESPACE)
    for known in SEPARATORS:
        own = F.when(pattern == re.escape(known), F.split("line", re.escape(known))).otherwise(own)
    rows = rows.where((F.length("line") > 0) & ~F.col("line").eqNullSafe(F.col("layout.header"))).withColumn("p", own)

    def part(place: str) -> Column:
        return F.trim(layouts.cell("p", place))

    dated = F.col("layout.date").isNotNull()
    number = F.col("__line") if "__line" in rows.columns else F.lit(None)
    parsed = parse_loose(F.coalesce(part("layout.date"), F.trim(F.get("p", F.lit(0)))))
    shown = F.when(dated, part("layout.date")).otherwise(F.concat(F.lit("row_"), number.cast("string")))
    named = merge_last_wins(layouts.placed("layout.others", "p"), layouts.placed("layout.prices", "p"))
    measurements = F.when(F.col("layout.names").isNotNull(), named).otherwise(_by_number("p"))
    return _rows(rows, F.coalesce(part("layout.series"), _stem()), parsed, shown, measurements, F.size("layout.prices") > 0)


def _empty(lines: DataFrame) -> DataFrame:
    return _canonical(lines.limit(0).withColumn("p", F.split("line", ",")), Layout(",", date=0))


def _numbered(lines: DataFrame) -> DataFrame:
    """0-based line number within each file, without sending a file to one task.

    Lines are counted per input block; a block starts after the lines of the blocks before it.
    """
    seen = lines.withColumn("__id", F.monotonically_increasing_id())
    blocks = lines.groupBy(SOURCE, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(SOURCE).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(SOURCE, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(SOURCE, "__block").orderBy("__id")
    return seen.withColumn("__row", F.row_number().over(inside)).join(starts, [SOURCE, "__block"]).withColumn(
        "__line", F.col("__start") + F.col("__row") - 1
    )


def _stem() -> Column:
    return F.regexp_replace("__name", r"(?<=.)\.[^.]*$", "")


def _by_number(parts: str) -> Column:
    """Without a header: as many measurements as the line has fields."""
    entries = F.transform(
        F.col(parts),
        lambda x, i: F.struct(F.concat(F.lit("value_"), i.cast("string")).alias("key"), token_value(x).alias("value")),
    )
    return F.map_from_entries(F.filter(entries, lambda e, i: (i > 0) & e["value"].isNotNull()))


def _canonical(rows: DataFrame, layout: Layout) -> DataFrame:
    def part(i: int) -> Column:
        return F.trim(F.get("p", F.lit(i)))

    series = _stem() if layout.series is None else F.coalesce(part(layout.series), _stem())
    if layout.date is not None:
        parsed, shown = parse_loose(part(layout.date)), part(layout.date)
    else:
        parsed = parse_loose(part(0))
        shown = F.concat(F.lit("row_"), F.col("__line").cast("string"))
    prices = {k: token_value(part(i)) for k, i in layout.prices.items()}
    if layout.names:
        used = {layout.date, layout.series, *layout.prices.values()}
        others = {
            n.lower().replace(" ", "_"): token_value(part(i))
            for i, n in enumerate(layout.names)
            if i not in used
        }
        measurements = merge_last_wins(schema.measurement_map(others), schema.measurement_map(prices)) \
            if others and prices else schema.measurement_map(others or prices)
    else:
        measurements = _by_number("p")
    return _rows(rows, series, parsed, shown, measurements, F.lit(bool(layout.prices)))


def _rows(rows: DataFrame, series: Column, parsed: Column, shown: Column, measurements: Column, priced: Column) -> DataFrame:
    read = {"series_id": series, "timestamp": parsed, "__shown": shown, "measurements": measurements, "priced": priced}
    shown_time = {"timestamp_raw": F.coalesce(iso_text(F.col("timestamp")), F.col("__shown"))}
    out = once(once(rows, read), shown_time).select(
        SOURCE,
        F.lit(None).cast("string").alias("error"),
        "series_id",
        "timestamp",
        "timestamp_raw",
        "measurements",
        F.lit(None).cast(schema.METADATA).alias("metadata"),
        F.lit(None).cast("string").alias("format"),
        "priced",
    )
    return out.where((F.coalesce(F.col("timestamp_raw"), F.lit("")) != "") & (F.col("priced") | (F.size("measurements") > 0))).drop("priced")
