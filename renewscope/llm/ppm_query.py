"""Query of the language identification; a learned model, so tests measure held-out accuracy."""

from pyspark.sql import functions as F

from renewscope.llm.common import id_fold, table
from renewscope.llm.ppm import language, train


def op1_language_id(spark, sf_dir):
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (id_fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", language(spark, model, F.col("text")).alias("x")).select("doc_id", "held_out", "x.lang_pred", "x.score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
