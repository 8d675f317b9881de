"""Query of the toxicity scores; a learned model, so tests measure held-out accuracy."""

from pyspark.sql import functions as F

from renewscope.llm.common import id_fold, table
from renewscope.llm.toxicity import toxicity, train

THRESHOLD = 0.5


def known_labels(spark, sf_dir):
    """doc_id and label of the rows that may be learned from."""
    return table(spark, sf_dir, "labels").where(id_fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))


def op6_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, known_labels(spark, sf_dir))
    scored = docs.select("doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
