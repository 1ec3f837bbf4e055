import glob

import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    """The small tables as lists of dicts."""

    def load(name):
        return pq.read_table(sorted(glob.glob(f"{SMALL}/{name}.parquet"))[0]).to_pylist()

    return load


#: Null id, null text, empty text, no words, a very long word, repeated rows, and columns whose names the operators use inside.
ODD_ROWS = [
    (1, "The house of the rising sun and the long road to the sea", "en", "src1", 5, "x"),
    (1, "The house of the rising sun and the long road to the sea", "en", "src1", 5, "x"),
    (1, "same id, other text", None, None, 5, "x"),
    (2, None, "en", "src1", None, None),
    (3, "", "de", "src2", 0, "y"),
    (4, " \t\n ", "de", None, 3, "y"),
    (5, "!!! ???", None, "src2", 7, "z"),
    (6, "a" * 50_000, "fr", "src3", 50_000, "z"),
    (7, "der die das und " * 4_000, "de", "src3", 64_000, "z"),
    (None, "no id here", "en", "src4", 10, "w"),
    (None, None, None, None, None, None),
]
ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, word string"


@pytest.fixture(scope="session")
def odd(spark):
    frame = spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)
    names = ("item", "print", "text_key", "spans", "base", "score", "position")
    return frame.selectExpr("*", *(f"'clash' AS {name}" for name in names))


@pytest.fixture(scope="session")
def odd_rows():
    return ODD_ROWS


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.limit(0)
