"""Query of the quality classifier; a learned model, so tests measure held-out accuracy."""

from pyspark.sql import functions as F

from renewscope.llm.common import id_fold, table
from renewscope.llm.quality import quality, train

THRESHOLD = 0.3


def known_labels(spark, sf_dir, column):
    """doc_id and label of the rows that may be learned from."""
    labels = table(spark, sf_dir, "labels").where(id_fold(F.col("doc_id"), 5) != 0)
    return labels.select("doc_id", F.col(column).alias("label"))


def op3_quality(spark, sf_dir):
    """Quality of every document."""
    model = train(table(spark, sf_dir, "documents"), known_labels(spark, sf_dir, "quality"))
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), quality(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
