"""Exact quantiles and ranks that never gather one group in one task.

Spark's `percentile` keeps all distinct values of a group in one buffer, which is
fine for a user's few rows and fatal for a class that holds a third of the table.
Here equal values are counted first, then an order-preserving bucket per value
splits every group into pieces of bounded number; running totals over buckets say
which bucket holds a wanted rank, and only that bucket is looked into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Buckets per doubling of the value. A double has about 2,100 doublings, so the
# number of buckets of a group is bounded whatever its number of rows.
STEPS = 1024


def value_bucket(value: Column, steps: int = STEPS) -> Column:
    """A whole number that never decreases as the value grows."""
    offset = F.lit(1100 * steps)
    size = F.floor(F.log2(F.abs(value)) * steps) + offset
    return (
        F.when(value == 0, F.lit(0).cast("long"))
        .when(value > 0, size)
        .otherwise(-size)
        .cast("long")
    )


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, bucket, value, n) with NULL values left out."""
    v = F.col(value).cast("double")
    return (
        df.where(v.isNotNull())
        .groupBy(*groups, v.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )


def _buckets(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per bucket: rows in it, rows before it, rows of the group."""
    by_group = W.partitionBy(*groups, F.lit(0))
    running = by_group.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        counts.groupBy(*groups, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_total", F.sum("_bn").over(by_group))
        .withColumn("_before", F.sum("_bn").over(running) - F.col("_bn"))
    )


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which NULL keys match each other."""
    renamed = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    cond = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, cond).drop(*[f"_r{i}" for i in range(len(keys))])


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                    probs: Sequence[float]) -> DataFrame:
    """(groups, prob, quantile, n) with linear interpolation between order statistics."""
    return quantiles_of_counts(value_counts(df, groups, value), groups, probs)


def quantiles_of_counts(counts: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The same from (groups, _v, _n, _b) as value_counts gives them, or sums of such counts."""
    groups = list(groups)
    wanted = (
        _buckets(counts, groups)
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_pos", (F.col("_total") - 1) * F.col("prob"))
        .withColumn("_rank", F.explode(F.array_distinct(
            F.array(F.floor("_pos").cast("long"), F.ceil("_pos").cast("long")))))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_bn")))
        .drop("_bn")
    )
    # Only the buckets that hold a wanted rank are ordered by value.
    in_bucket = W.partitionBy(*groups, "_b", "prob", "_rank").orderBy("_v")
    hits = (
        _match(counts, wanted, [*groups, "_b"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(
            in_bucket.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .where((F.col("_rank") >= F.col("_upto") - F.col("_n")) & (F.col("_rank") < F.col("_upto")))
    )
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    part = F.first("_pos") - F.floor(F.first("_pos"))
    return hits.groupBy(*groups, "prob").agg(
        (low + (high - low) * part).alias("quantile"), F.first("_total").alias("n"))


def quantile_columns(df: DataFrame, groups: Sequence[str], value: str,
                     named: dict[str, float]) -> DataFrame:
    """One row per group, one column per named quantile."""
    long = exact_quantiles(df, groups, value, sorted(set(named.values())))
    cols = [F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(name)
            for name, p in named.items()]
    return long.groupBy(*groups).agg(*cols)


def value_ranks(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, n, min_rank, avg_rank): 1-based ascending ranks of each value."""
    groups = list(groups)
    counts = value_counts(df, groups, value)
    buckets = _buckets(counts, groups).select(*groups, "_b", "_before")
    in_bucket = W.partitionBy(*groups, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.col("_before") + F.sum("_n").over(in_bucket) - F.col("_n")
    return _match(counts, buckets, [*groups, "_b"]).withColumn("_first", first).select(
        *groups, F.col("_v").alias(value), F.col("_n").alias("n"),
        (F.col("_first") + 1).alias("min_rank"),
        (F.col("_first") + (F.col("_n") + 1) / 2).alias("avg_rank"))
