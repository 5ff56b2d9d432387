import os

import pytest

SMALL = "/root/testdata/sf0.001"

#: (doc_id, text, lang, source, n_chars, and columns whose names clash with results)
EDGES = [
    (1, None, "xx", "s", 0, "keep", 7), (2, "", None, None, 0, "keep", 7), (3, "   \n\t ", "xx", "s", 5, "keep", 7), (4, "one", "xx", None, 3, "keep", 7), (5, "one two", None, "s", 7, "keep", 7),
    (6, "alpha beta gamma delta epsilon zeta eta theta", "xx", "t", 46, "keep", 7), (6, "alpha beta gamma delta epsilon zeta eta theta", "xx", "t", 46, "keep", 7),
    (7, "alpha beta gamma delta epsilon zeta eta theta", "xx", "t", 46, None, None), (None, "no id here at all", "xx", "s", 17, "keep", 7), (8, "word " * 60_000, "xx", "s", 300_000, "keep", 7), (9, "x" * 100_000, "yy", "s", 100_000, "keep", 7),
    (10, "É ü 漢字 🙂 <|endoftext|>\r\n \x1c end", "yy", "\U0001f600", 30, "keep", 7), (-3, "negative id", "yy", "s", 11, "keep", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int"


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no tables here")
    return spark.read.parquet(f"{SMALL}/documents.parquet")
