import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
#: Rows that every operator on documents must stand: nulls, empties, blanks, ties, repeats, one very long text.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog.\nA line that two share\n\n", "en", "a", 1),
    (2, "  a LINE that two share\t\nanother one here\na line that two share", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n\x0b ", None, "b", 5),
    (None, "A line that two share\nonly the row without an id has this", "en", None, 9),
    (None, None, "de", "b", 0),
    (7, "The quick brown fox jumps over the lazy dog.\nA line that two share\n\n", "en", "a", 1),
    (7, "The quick brown fox jumps over the lazy dog.\nA line that two share\n\n", "en", "a", 1),
    (8, "word " * 60_000 + "\n" + "\n".join(f"line number {k}" for k in range(3000)), "en", "a", 1),
    (9, "line number 5\nline number 2999\n日本語のテキスト ﬁ ▁ \U0001f600\r\n  two  spaces ", "ja", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns named like those that the operators add."""
    from pyspark.sql import functions as F

    names = ("kept_text", "n_lines", "fp", "score", "predicted", "held_out", "lang_pred", "ids", "kept", "start", "n_words", "a.b")
    return odd.select("*", *(F.lit(f"old {n}").alias(n) for n in names))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def sf():
    return SF
