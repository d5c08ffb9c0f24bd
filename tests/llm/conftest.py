"""Fixtures with the rows every operator must take: nulls, empty and long texts, repeats, clashing columns."""

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard_rows():
    words = " ".join(f"word{i % 97}" for i in range(400))
    return [
        (1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, words + " tail", "en", None, 2),
        (3, None, "en", "b", None), (4, "", None, "b", 0), (5, " \t\n ", "fr", "b", 4), (None, words, "en", "a", 9),
        (None, None, None, None, None), (6, "12345 !!! 67", "fr", "c", 3), (7, "x" * 50_000, "en", "c", 50_000),
        (8, "été à la mer " * 4_000, "fr", "c", 8), (9, words, "fr", "c", 9), (10, "one line\n" * 300, "en", "a", 3)]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(hard):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    return hard.select("*", *[F.lit(1).alias(c) for c in (
        "row", "body", "score", "fp", "component_id", "size", "copies", "nth", "ids", "n_tokens", "spans",
        "kept", "key", "b", "dkey", "stratum", "redacted", "lang_pred", "root", "of", "id")])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
