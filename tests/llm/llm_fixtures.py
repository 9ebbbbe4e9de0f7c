"""Fixtures shared by the tests of this folder."""
import pytest

SF_SMALL = "/root/testdata/sf0.001"
ODD_TEXTS = [
    None, "", " ", "\n\t", "one", "One two THREE four five", "é É ß Σ", "a " * 30000, "x" * 50000,
    "Licensed under the Apache License, Version 2.0.", "line\r\nline\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc",
    "<|end|> <|endoftext|> \\ </turn> ### Assistant:", "the same text twice here ok", "the same text twice here ok",
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hit string, score string, block string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, clashing extra columns."""
    rows = [(i, t, None, "src0", None, "h", "s", "b") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "a row without an id is kept as it is", None, None, None, None, None, None), rows[5], rows[5]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
