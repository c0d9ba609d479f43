"""Documents with the awkward cases that every text operator must define."""

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))

ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", None, None, 6),
    (4, "One two", "en", "a", 7),
    (5, "one TWO", "en", "b", 7),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG + " end", "en", "b", len(LONG) + 4),
    (8, "start " + PASSAGE + " finish here", "fr", "b", 400),
    (9, "other " + PASSAGE, "fr", None, 400),
    (9, "other " + PASSAGE, "fr", None, 400),
    (10, "a" * 5000, "de", "c", 5000),
    (None, "other " + PASSAGE + " tail", "de", "c", 400),
    (12, "été déjà vu à Noël — ça va? ünïcödé " * 12, "fr", "c", 400),
    (13, "𝔘𝔫𝔦   text with odd spaces", "en", "c", 30),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Also has columns whose names the operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in ("sid", "tid", "key", "data", "n", "size", "head", "n_words", "removed", "root", "spans", "kept", "severity", "h")}).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
