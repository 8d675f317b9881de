import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(n, seed):
    return " ".join(WORDS[(i * 7 + seed * 13 + i * i) % len(WORDS)] + str((i * seed) % 5) for i in range(n))


ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, None), (4, "one", "en", "b"), (5, "one two", "de", "b"),
    (6, sentence(40, 6), "en", "a"), (6, sentence(40, 6), "en", "a"), (6, sentence(30, 9), "en", "c"), (None, sentence(20, 3), "en", "a"),
    (None, sentence(20, 3), "en", "a"), (7, sentence(60_000, 7), "en", "a"), (8, "x" * 200_000, "de", "a"), (9, "ñandú çà 日本語 \U0001f600 é", "es", None),
    (10, sentence(50, 4), "de", "b"), (11, sentence(50, 4), "de", "c"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and extra columns with names that operators use."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    extra = {n: F.lit(n) for n in ("size", "score", "__id", "range", "held_out", "document", "label", "rank", "live", "__row_hash", "fp", "k", "id", "copies")}
    return docs.withColumns(extra).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1), (2, 0), (6, 1), (6, 0), (10, 0), (None, 1), (4, None), (7, 1), (99, 0)]
    return spark.createDataFrame(rows, "doc_id long, label int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
