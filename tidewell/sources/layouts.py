"""Layouts of text files as data: what the first lines of each file say, joined to its lines.

One aggregate finds the first lines of every file, a small function turns each distinct pair of them into
positions, and fields are placed by these positions. So files of any number of layouts are one branch of the
plan, and no list of files or headers reaches the driver.
"""

from __future__ import annotations

import csv
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewell import schema
from tidewell.functions.tokens import token_value
from tidewell.session import written

SOURCE = "source_file"

NAMED_SQL = "array<struct<name: string, at: int>>"
NAMED = pa.list_(pa.struct([("name", pa.string()), ("at", pa.int32())]))


def named(places: dict[str, int]) -> list[dict]:
    return [{"name": n, "at": i} for n, i in places.items()]


def lines_of(spark: SparkSession, path: str | list[str], trimmed: bool = False) -> DataFrame:
    """(source_file, __name, block, id, line) of the lines below ``path`` that are not blank; ids grow along a file."""
    value = F.trim("value") if trimmed else F.col("value")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias(SOURCE),
        F.col("_metadata.file_name").alias("__name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        value.alias("line"),
    )
    return lines.where(F.length(F.trim("line")) > 0)


def first_lines(lines: DataFrame, count: int = 1) -> DataFrame:
    """(source_file, first_id, top): the first ``count`` lines of each file.

    A task passes on the least lines of each file it reads, so a file gives a few rows, whatever its size.
    """
    row = F.struct("id", "line")
    start = lines.where(F.col("block") == 0)
    top = start.groupBy(SOURCE).agg(F.min(row).alias("r0"))
    for k in range(1, count):
        later = start.join(top.select(SOURCE, F.col(f"r{k - 1}.id").alias("_id")), SOURCE).where(F.col("id") > F.col("_id"))
        top = top.join(later.groupBy(SOURCE).agg(F.min(row).alias(f"r{k}")), SOURCE, "left")
    texts = F.array(*[F.col(f"r{k}.line") for k in range(count)])
    return top.select(SOURCE, F.col("r0.id").alias("first_id"), texts.alias("top"))


def fields_of(line: str | None, separator: str) -> list[str]:
    """The fields of a line with quotes as CSV has them."""
    return next(csv.reader([(line or "").removeprefix("\ufeff").rstrip("\r\n")], delimiter=separator), [])


def described(tops: DataFrame, read: Callable[..., dict], kind: pa.StructType, sql: str) -> DataFrame:
    """(source_file, first_id, layout): ``read`` applied to each distinct group of first lines, in tasks."""

    def run(top: pa.Array) -> pa.Array:
        return pa.array([read(*lines) for lines in top.to_pylist()], kind)

    tops = written(tops, "first_lines")
    known = tops.select("top").distinct().withColumn("layout", F.arrow_udf(run, sql)("top"))
    return written(tops.join(known, "top").drop("top"), "layouts")


def only_one(layouts: DataFrame) -> Row | None:
    """The layout that all files share, if they do: two rows reach the driver at most."""
    some = layouts.select("layout").distinct().limit(2).collect()
    return some[0]["layout"] if len(some) == 1 else None


def with_cells(lines: DataFrame, layouts: DataFrame, separator: str) -> DataFrame:
    """The lines behind the first of each file, with their ``layout`` and its CSV ``cells``, one more than the widest has."""
    width = (layouts.agg(F.max("layout.width")).first()[0] or 0) + 1
    names = [f"c{i}" for i in range(width)]
    own = lines.join(layouts, SOURCE).where(F.col("id") > F.col("first_id"))
    cut = own.withColumn("cut", F.from_csv("line", ", ".join(f"{n} string" for n in names), {"sep": separator}))
    return cut.withColumn("cells", F.array(*[F.col(f"cut.{n}") for n in names])).drop("cut")


def cell(cells: str, place: str) -> Column:
    return F.get(F.col(cells), F.col(place))


def placed(named: str, cells: str, keep_empty: bool = False) -> Column:
    """A measurement map of the cells at the named places."""
    entries = F.transform(
        named, lambda p: F.struct(p["name"].alias("key"), token_value(F.get(F.col(cells), p["at"])).alias("value"))
    )
    if not keep_empty:
        entries = F.filter(entries, lambda e: e["value"]["raw"].isNotNull())
    return F.coalesce(F.map_from_entries(entries), F.create_map().cast(schema.MEASUREMENTS))
