import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

EXTRA = "o long, k int, n long, key long, label int, start int, prefix string, held_out string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"pass{i}" for i in range(70))
ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (4, "one", "en", "a"),
    (4, "one", "en", "a"),
    (5, "One", "en", None),
    (6, "two words", "fr", "b"),
    (7, LONG, "de", "b"),
    (8, LONG + " tail", "de", "b"),
    (9, "before " + PASSAGE + " after", "en", "c"),
    (10, "other start here " + PASSAGE + " and end", "en", "c"),
    (10, "other start here " + PASSAGE + " and end", "en", "c"),
    (11, "Ünïcödé … 数字 !!!", None, "c"),
    (None, "a text without id " + PASSAGE, "en", "d"),
    (None, None, None, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty, very long and repeated rows, with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, la, s, None, 1, 2, 3, 4, 5, 6, "x", "y") for i, t, la, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
