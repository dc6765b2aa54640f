from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture
def table(spark: SparkSession):
    """Rows to a table by a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


#: Texts that every operator must take.
ODD_TEXTS = [None, "", " \n\t ", "one", "one two", "a b c", "A B C", "é ü x", "x" * 70_000, "word " * 30_000,
             "line one here\nline two here\nline three here\nline four", "same text here now", "same text here now"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark: SparkSession):
    """Nulls in every column, empty and long texts, ties, and a row that occurs twice."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", "en", "a", None), (None, None, None, None, None)], DOCS)


@pytest.fixture
def odd(spark):
    return odd_docs(spark)
