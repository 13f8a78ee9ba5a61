import pytest
from odd_rows import ROWS


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators use inside or return."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    names = ["id", "key", "n", "h", "line", "line_no", "rep", "bits", "prefix", "component_id", "n_shingles", "token_ids", "n_tokens", "shard", "bytes", "fingerprint", "toxicity", "score", "root", "need", "at", "kind"]
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
