"""Query of the SimHash near-duplicates. XXH64 with a seed is not SQL; tests compare all pairs."""

from pyspark.sql import functions as F

from renewscope.llm.common import table
from renewscope.llm.simhash import near_duplicates

SHINGLE, DISTANCE = 3, 2


def op5_simhash(spark, sf_dir):
    """Fingerprint and group of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=SHINGLE, distance=DISTANCE)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
