"""Small tables with every awkward case."""

import pytest
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _t string, _h string, _row string, "
    "key long, score double, t string, kept boolean, `_id` long, v long, word long"
)


def long_text(n=30_000):
    return " ".join(f"w{i * 7919 % 4001}" for i in range(n))


def awkward_rows():
    base = "The quick brown fox jumps over the lazy dog while seven wizards box with quartz jars and nothing else happens here today."
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"),  # a repeated row
        (3, None, "en", None), (4, "", None, "a"), (5, "  \n\t ", "de", "b"), (6, "1234 !!!", "de", "b"),
        (None, base, "en", "b"), (None, None, None, None), (7, long_text(), "fr", "c"),
        (8, base + " Yes.", "en", "c"), (9, "Ein kurzer Satz über Äpfel und Öl.", "de", "c"), (9, "un", "fr", "c"),
        (10, "one two three", "en", None), (11, "one two three", "en", "d"),
    ]
    extra = (None, "x", None, 5, 0.5, "y", None, None, 3, None)
    return [(*r, len(r[1]) if r[1] else None, *extra) for r in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).withColumn("doc_id", F.col("doc_id"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
