import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns named like the operators' own."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog today.", 7, "a"), (2, "THE quick brown fox jumps over the lazy dog today.", None, "b"),
        (2, "THE quick brown fox jumps over the lazy dog today.", None, "b"), (None, "The quick brown fox jumps over the lazy dog today.", 1, None),
        (3, None, 2, "c"), (4, "", 3, "d"), (5, " \n\t ", 4, "e"), (6, "word " * 60_000, 5, "f"), (7, "é́ 日本 😀 x", 6, "g"), (None, None, None, None),
        (8, "a b", 1, "h"), (9, "one", 1, "i"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, group_size long, row string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
