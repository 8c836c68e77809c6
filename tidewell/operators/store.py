"""The record store: Parquet partitioned by date, sorted by series and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.duplicates import comparable
from tidewell.operators.query import PROMOTED
from tidewell.session import work_path

KEYS = ("series_id", "timestamp")


#: set by ``upsert``: what arrives wins over what is stored
WAVE = "__wave"


def latest_versions(df: DataFrame, version: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key, the one with the highest version: the last write wins.

    A row without a readable time is no version of another one: only rows equal in all columns but
    ``version`` are one. Spark cuts each key to one row per input partition before the shuffle.
    """
    keyed = {f"__k{i}": comparable(df, k) for i, k in enumerate(keys)}
    if "timestamp" in keys:
        rest = [c for c in df.columns if c not in (*keys, *version, "date", WAVE)]
        untimed = F.col("timestamp").isNull()
        keyed |= {f"__u{i}": F.when(untimed, comparable(df, c)) for i, c in enumerate(rest)}
    order = [F.col(v).desc() for v in ([WAVE] if WAVE in df.columns else []) + list(version)]
    newest = Window.partitionBy(*keyed).orderBy(*(order or [F.lit(0)]))
    ranked = df.withColumns(keyed).withColumn("__rn", F.row_number().over(newest))
    return ranked.where(F.col("__rn") == 1).drop("__rn", *keyed)


def _laid_out(df: DataFrame) -> DataFrame:
    """Range-partition by (date, series, time): one busy series or day spreads over many files."""
    order = ["date", *KEYS]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def with_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date("timestamp"))


def with_promoted(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The numbers of ``metrics`` as columns beside the map."""
    return df.withColumns({f"{PROMOTED}{m}": F.col("measurements")[m]["num"] for m in metrics}) if metrics else df


def promoted_metrics(df: DataFrame) -> list[str]:
    return [c.removeprefix(PROMOTED) for c in df.columns if c.startswith(PROMOTED)]


def save(df: DataFrame, path: str, promoted: Sequence[str] = ()) -> None:
    """Write a new store. The ``promoted`` metrics are typed columns beside the map, in this and every later write."""
    _laid_out(with_date(with_promoted(df, promoted))).write.partitionBy("date").parquet(path, mode="errorifexists")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All records, with the columns of all files: a later one may have more."""
    return spark.read.option("mergeSchema", True).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Records that carry a time, as the plots read them; nothing is capped."""
    return stored(spark, path).where(F.col("timestamp").isNotNull())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def upsert(spark: SparkSession, path: str, arriving: DataFrame, version: Sequence[str] = ()) -> None:
    """Merge ``arriving`` into the store; the same series and time overwrites.

    Arriving rows win over stored ones, whatever their ``version``; among arriving rows of one key the highest
    version wins. Records without a readable time are kept, in the partition of the null date. Columns that
    only one side has stay. Only the dates that ``arriving`` touches are read and rewritten. The merged rows
    are written to the shared folder first and moved from there, so the store is never read and overwritten
    by one job, and a failed job can be repeated; the staged copies are removed after the commit. Metrics that
    the store keeps as columns are columns of the arriving rows too. Files of several dates are replaced one
    date after the other: a reader meanwhile may see some dates before and some after the upsert.
    """
    known = exists(spark, path)
    if known:
        arriving = with_promoted(arriving, promoted_metrics(stored(spark, path)))
    fresh = with_date(arriving).withColumn(WAVE, F.lit(1))
    if not known:
        _laid_out(latest_versions(fresh, version).drop(WAVE)).write.partitionBy("date").parquet(path)
        return
    root = work_path(spark, "upsert")
    fresh.write.parquet(f"{root}/arriving")
    staged = spark.read.schema(fresh.schema).parquet(f"{root}/arriving")
    span = staged.agg(
        F.min("date").alias("low"), F.max("date").alias("high"), F.count("*").alias("n"), F.count("date").alias("dated")
    ).first()
    if span["n"]:
        old = stored(spark, path).withColumn(WAVE, F.lit(0))
        # the span prunes folders before anything is read, the semi join leaves the touched ones
        days = staged.select("date").where("date IS NOT NULL").distinct()
        touched = old.where(F.col("date").between(F.lit(span["low"]), F.lit(span["high"]))).join(days, "date", "left_semi")
        both = touched.unionByName(staged, allowMissingColumns=True)
        if span["dated"] < span["n"]:
            both = both.unionByName(old.where(F.col("date").isNull()), allowMissingColumns=True)
        merged = latest_versions(both, version).drop(WAVE)
        merged.write.parquet(f"{root}/merged")
        (
            _laid_out(spark.read.schema(merged.schema).parquet(f"{root}/merged"))
            .write.partitionBy("date")
            .option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .parquet(path)
        )
    _remove(spark, root)


def new_keys(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys present afterwards but not before."""
    return after.select(*keys).distinct().join(before.select(*keys), list(keys), "left_anti")


def with_series_metadata(
    points: DataFrame, records: DataFrame, order: Sequence[str | Column] = ("timestamp",)
) -> DataFrame:
    """Give each point the metadata of the first record of its series.

    No broadcast hint: Spark broadcasts the lookup when its measured size allows, and
    otherwise splits a heavy series by adaptive skew join.
    """
    first = records.groupBy("series_id").agg(
        F.min_by("metadata", F.struct(*order)).alias("metadata")
    )
    return points.drop("metadata").join(first, "series_id", "left")
