"""Query of the nearest neighbours; an index may miss some, so tests measure it against all pairs."""

from pyspark.sql import functions as F

from renewscope.llm.common import table
from renewscope.llm.forest import nearest


def op9_nearest(spark, sf_dir):
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


QUERIES = {"op9_nearest": op9_nearest}
ORACLES: dict[str, str] = {}
