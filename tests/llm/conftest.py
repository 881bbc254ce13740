import pytest
from pyspark.sql import functions as F  # noqa: F401

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a", 1),
    (2, None, "en", "a", 2),
    (3, "", None, None, 3),
    (4, " \t\n ", "en", "b", 4),
    (5, "The quick brown fox jumps over the lazy dog again and again today", "en", "b", 5),
    (6, "The  quick brown fox jumps over the lazy\ndog again and again today", None, "b", 6),
    (7, "one two", "en", "c", 7),
    (8, "long " * 20000 + "end", "en", "c", 8),
    (9, "über Straße naïve 日本語 😀 x@y.example.com", "de", None, 9),
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a", 1),
    (None, "one two", "en", "c", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(EDGE, SCHEMA).repartition(3)
    for name in ("name", "block", "unit", "size", "copies", "level", "rid", "component", "text_sha256", "anchor", "key", "s", "n", "_salt", "_row"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
