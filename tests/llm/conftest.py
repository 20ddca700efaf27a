from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

TABLES = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 60_000

# Nulls in every column, empty and white texts, a very long one, repeated rows and ids.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 63),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 63),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 63),
    (3, "Le renard brun saute par-dessus le chien paresseux", "fr", "b", 50),
    (4, None, "en", "b", None),
    (5, "", None, None, 0),
    (6, " \t\n ", "en", None, 4),
    (None, "orphan text without an id", "en", "c", 25),
    (7, LONG, "en", "a", len(LONG)),
    (8, "mail me at jo.doe@mail.example.com or +1 (212) 555-0199", "en", "c", 55),
    (9, "again jo.doe@mail.example.com wrote", "en", "c", 35),
    (10, "one", "en", "c", 3),
]


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(TABLES):
        pytest.skip("no test tables")
    return TABLES


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="session")
def odd(docs):
    """The same rows with further columns whose names operators might use themselves."""
    names = "size rank uniform copies target row of special_id special_rows gone_id print node grade tail ids part IDS2 found".split()
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(1).alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
