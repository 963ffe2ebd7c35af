import pytest

DATA = "/root/testdata/sf0.001"
#: Rows that every operator on texts must take: nulls, empty texts, ties, repeated rows, a long text.
ODD = [(1, None, "x"), (None, "x", "a"), (None, None, None), (2, "a b c", "a"), (2, "a b c", "a"), (2, "other text", "b"), (3, "", "b"), (4, "é𝒳   word. " * 4000, "a")]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """With columns whose names clash with those used inside."""
    df = spark.createDataFrame([(a, b, c, "c", 1, 2, 3) for a, b, c in ODD], "doc_id long, text string, source string, id string, key long, h long, n_chars long")
    return df.withColumn("lang", df["id"])
