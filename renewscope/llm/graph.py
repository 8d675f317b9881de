"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewscope.session import through_table


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node of a table of links (a, b).

    Each round ties every node's larger neighbours to its smallest one, then every node and its
    smaller neighbours to the smallest; the number of rounds grows with the logarithm of the
    longest path. The links of a round are written to the shared folder. Minima are
    pre-aggregated; a node with very many links is a skewed sort-merge join, which Spark splits.
    Links of a node to itself and nulls are left out.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links = through_table(links, "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("n")).select("a", F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("x"), "m")
        links = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        links = through_table(links.where("a > b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
