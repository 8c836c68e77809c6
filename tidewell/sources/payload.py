"""Records inside landed API responses."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where the records of a response are looked for when no path is given.
USUAL_PLACES = ["data", "results", "values"]

UNREADABLE = "Response is no JSON, or larger than 128 MiB"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT ``response`` per landed file, with its ``source_file``; where there is none, ``error`` says why."""
    read = spark.read.option("singleVariantColumn", "response").option("multiLine", True).json(path)
    error = F.when(F.col("response").isNull(), UNREADABLE)
    return read.select("response", F.col("_metadata.file_path").alias("source_file"), error.alias("error"))


def rejected_responses(responses: DataFrame) -> DataFrame:
    """The files that gave no response, and why."""
    return responses.where(F.col("error").isNotNull()).drop("response")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))


def extract_records(responses: DataFrame, path: str = "data", column: str = "response") -> DataFrame:
    """One VARIANT ``record`` per element found; a single value at a path counts as one record.

    Without a path (or with ``data``) the usual places are tried, then the response itself
    when it is a list. Nothing found means no record. The other columns follow, without ``error``.
    """
    whole = F.col(column)
    if not path or path == "data":
        places = [F.try_variant_get(column, f"$['{p}']", "variant") for p in USUAL_PLACES]
        found = F.coalesce(*places, F.when(_kind(whole).startswith("ARRAY"), whole))
        single = F.lit(None)
    else:
        steps = "".join(f"['{key}']" for key in path.split("."))
        found = F.try_variant_get(column, f"${steps}", "variant")
        single = F.when(~_kind(found).isin("ABSENT", "VOID"), F.array(found))
    many = F.when(_kind(found).startswith("ARRAY"), F.try_variant_get(found, "$", "array<variant>"))
    rest = [c for c in responses.columns if c not in (column, "error")]
    return responses.select(F.explode(F.coalesce(many, single) if path and path != "data" else many).alias("record"), *rest)


def map_fields(records: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the fields of a VARIANT ``record``: mapped names first, the others pass through."""
    fields = F.try_variant_get("record", "$", "map<string,variant>")
    renamed = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    mapped = F.map_filter(fields, lambda k, _: k.isin(*mapping))
    other = F.map_filter(fields, lambda k, _: ~k.isin(*mapping) & ~k.isin(*mapping.values()))
    clash = F.map_filter(
        fields, lambda k, _: ~k.isin(*mapping) & k.isin(*mapping.values())
    )
    named = F.transform_keys(mapped, lambda k, _: F.element_at(renamed, k))
    # an unmapped field of the same name is met later, so it wins
    kept = F.map_filter(named, lambda k, _: ~F.map_contains_key(clash, k))
    return records.withColumn("record", F.to_variant_object(F.map_concat(kept, clash, other)))


def rename_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """The same for typed columns."""
    taken = [std for api, std in mapping.items() if api in df.columns and std in df.columns and std not in mapping]
    usable = {a: s for a, s in mapping.items() if a in df.columns and s not in taken}
    first = [F.col(f"`{a}`").alias(s) for a, s in usable.items()]
    return df.select(*first, *[F.col(f"`{c}`") for c in df.columns if c not in mapping])
