"""Documents with every awkward case, and helpers shared by the operator tests."""

import pytest
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"
LONG = " ".join(f"word{k % 977} tail{k % 13}" for k in range(12_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven silent sailors sort shiny shells on sunny southern shores "
BASE = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (2, "alpha beta\tgamma delta epsilon  zeta eta theta", "en", "b"),
    (3, "alpha beta gamma delta epsilon zeta eta iota", "de", None),
    (4, "", "fr", "a"),
    (5, None, None, None),
    (6, " \n\t ", "en", "c"),
    (7, LONG, "en", "a"),
    (8, LONG, "en", "b"),
    (9, LONG + " end", "en", "a"),
    (10, "ümlaut ünd ß 漢字 \U0001f600 words", "de", "d"),
    (10, "ümlaut ünd ß 漢字 \U0001f600 words", "de", "d"),  # a repeated row
    (None, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (None, None, None, "z"),
    (11, PASSAGE * 3, "en", "a"),
    (12, "before. " + PASSAGE * 2 + " after", "en", "b"),
    (13, "x" * 5000, "es", "a"),
    (14, "line one\nline one\nline two\n\nline one", "en", "a"),
    (15, "ab\x00cd \x1c\x85 ef", "en", "b"),
]
CLASHES = ("kept", "keep_id", "group", "digit", "n", "key", "run", "pos", "fp", "component_id", "tokens", "weight", "ids", "score", "n_lines",
           "shard", "slot", "band", "size", "carried", "rest", "page_id", "row", "line", "h", "occ", "bucket", "blob", "draw", "raw")


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))


@pytest.fixture(scope="module")
def edge(spark):
    """All awkward rows over several partitions, with extra columns named like internal ones."""
    return documents(spark, BASE).repartition(3, "text").withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def texts():
    return [(r[0], r[1] or "") for r in BASE]
