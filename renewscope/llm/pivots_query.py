"""Query of the embedding near-duplicates; an index may miss links, so tests measure it against all pairs."""

from renewscope.llm.common import table
from renewscope.llm.pivots import near_duplicates


def op4_embedding_dedup(spark, sf_dir):
    """Links and group of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
ORACLES: dict[str, str] = {}
