import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns whose names clash with the operators' own."""
    long = " ".join(f"word{i * 7919 % 5003} x{i}" for i in range(60_000))
    plain = " ".join(f"alpha{i} beta{i % 13} gamma" for i in range(60))
    rows = [
        (1, plain, "en", "a", 10), (1, plain, "en", "a", 10), (2, plain, "en", "b", 10), (None, plain, "en", None, None), (3, None, None, "b", 3), (None, None, None, None, None), (4, "", "de", "a", 0), (5, "  \n\t ", "de", "a", 5),
        (6, long, "en", "c", len(long)), (7, "Zürich ÀÉ one two three four", "fr", "b", 1), (8, plain + " changed", "en", "c", 4), (9, "x" * 500, None, "d", 1), (10, "ab " * 400, "en", "d", 2),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    clashing = ["row", "_id", "_hash", "size", "fp", "shard", "_n", "target", "root", "g", "w"]
    return docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in clashing]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
