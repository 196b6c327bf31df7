"""Fixtures of the text operators' tests: the session is that of the other tests."""

from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def texts(spark, data):
    """All texts of the smallest documents."""
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture
def odd_docs(spark):
    """Missing, empty, very long, repeated and clashing: what every operator must get through."""
    long_word, long_text = "x" * 70_000, "the quick brown fox jumps over it. " * 6_000
    rows = [
        (1, None, "en", "a", 7, "c0"),
        (2, "", "en", None, None, "c1"),
        (3, long_text, None, "a", 0, None),
        (4, long_word, "de", "b", 1, "x"),
        (5, "Ab cé 日本\U0001f600 it's  'll\n\n\t password=abcdefgh12 ", "en", "a", 2, ""),
        (5, "Ab cé 日本\U0001f600 it's  'll\n\n\t password=abcdefgh12 ", "en", "a", 2, ""),
        (6, " \n\t ", "en", "a", 3, "y"),
        (None, "no id here but words enough to count", "fr", "a", 3, "z"),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, band string"
    ).withColumnsRenamed({"band": "words"})


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
