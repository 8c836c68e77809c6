"""Documents to training sequences: five stages, each over all that the one before it kept.

Each stage is written as Parquet and read again before the next, so a lost executor costs one stage's
tasks only. ``STAGES`` lists them, ``run`` applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontamination, jaccard, language, line_dedup, packing
from tidewell.llm.common import ready, table
from tidewell.session import written


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; the number of characters follows the text."""
    own = [F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return df.select(*own)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those the model is not sure of, go."""
    said = language.identify_languages(docs, language.fit_languages(docs))
    return said.where(~F.col("rejected")).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them."""
    return _as_documents(line_dedup.dedup_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter passages of test items are cut from the others."""
    clean = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _as_documents(clean.where(~F.col("contaminated")), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their bins and places."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: the language model is trained, and bins depend on its result: no SQL gives these rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
