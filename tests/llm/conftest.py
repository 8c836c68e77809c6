import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key string, doc long, found string, N_WORDS string, score string, shard string, items string, bin string"
)


def document(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), "k", 5, "f", "w", "c", "h", "i", "b")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, ties, and extra columns with names the operators use."""
    passage = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = [
        document(1, None),
        document(2, ""),
        document(3, passage),
        document(3, passage),
        document(None, passage),
        document(None, None, source=None, lang=None),
        document(4, f"{passage}\nown line of four\n{passage}"),
        document(5, f"\n\n  {passage.upper()}\t\nUnder the MIT License. under  the mit-license\n"),
        document(6, "word " * 120_000),
        document(7, "Éa ñu ßK 12 the"),
        document(8, "... !!! 123"),
        document(None, "a b c"),
        document(9, f"Licensed under the Apache License, Version 2.0 and CC BY NC\r\n{passage} again"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return odd_documents.limit(0)


def row_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
