"""Python workers find the library from any working folder."""

import os
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
os.environ["PYTHONPATH"] = ":".join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF = "/root/testdata/sf0.001"

#: Nulls, empty and long texts, ties and repeated rows, and columns whose names the operators use.
ODD_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "a", 7),
    (1, "the quick brown fox jumps over the lazy dog again and again", "a", 7),
    (2, "the quick brown fox jumps over the lazy dog again and again", "b", 8),
    (2, "another text with the same id", None, None),
    (3, "", "b", 9),
    (4, None, None, None),
    (None, "a row without id but with words", "a", 1),
    (None, None, None, None),
    (5, "word", "c", 2),
    (6, "long " * 20_000 + "end", "c", 3),
    (7, "x" * 70_000, "c", 3),
    (8, " \t\n ", "a", 4),
]
ODD_SCHEMA = "doc_id long, text string, source string, size long"


@pytest.fixture(scope="session")
def odd(spark):
    """A frame of odd rows with columns n, cls, key, root, score, lines, h, score and size besides those of documents."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA).select("*", *[F.lit(c).alias(c) for c in ("n", "cls", "key", "root", "score", "lines", "h", "range", "at", "label", "toxic", "item_id")])


@pytest.fixture(scope="session")
def none(odd):
    """The same columns without rows."""
    return odd.where("false")
