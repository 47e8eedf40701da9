import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta", "en", "a", 10), (1, "alpha beta gamma delta epsilon zeta eta", "en", "a", 10), (2, None, "en", "a", None),
        (3, "", None, "a", 0), (4, " \n\t ", "en", None, 3), (None, "no id here but some words", "en", "b", 5), (5, long, "en", "b", 1), (5, "other text, same id", None, None, None),
        (6, "ünïcödé ▁▁ 日本語 👍🏽 \x00 end", "de", "b", 2), (7, "one", "en", "a", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing():
    """Adds columns with the names that operators use."""

    def add(df):
        names = "fingerprint shard slot toxicity evidence quality tiff pages ids n_tokens code signature posterior rate copies host path bound _part part".split()
        return df.withColumns({n: F.lit("clash") for n in names}).withColumn("a b.c", F.lit(1))

    return add
