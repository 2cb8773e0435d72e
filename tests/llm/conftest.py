import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and river stone cloud window paper garden quiet letter morning silver road bridge".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * 17) % len(WORDS)] + str((seed * 31 + i) % 97) for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows."""
    long = prose(1, 30_000)
    return [
        (1, None, "en", None, None), (2, "", None, "s", 0), (3, " \t\n ", "en", "s", 4), (4, "word", "en", "s", 4), (5, "two words", None, None, None),
        (6, long, "en", "s", len(long)), (7, long, "en", "s", len(long)), (7, long, "en", "s", len(long)), (None, prose(2, 120), "en", "s", 1), (None, None, None, None, None),
        (10, prose(3, 120), "en", "s", 1), (11, prose(3, 120) + " tail", "en", "s", 1), (12, "x " * 400, "fr", "s", 800), (13, "Über 漢字 'tis   end", "de", "s", 5), (14, prose(4, 80), "en", "s", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with columns more whose names an operator might use itself."""
    rows = spark.createDataFrame(odd_rows, SCHEMA)
    for name in ("ids", "block", "bucket", "fp", "m", "c", "score", "kept_text", "spans", "component", "vec_id", "u", "v"):
        rows = rows.withColumn(name, F.lit("taken"))
    return rows


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
