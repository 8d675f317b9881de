"""Descriptive aggregates: distributions, crosstabs, missingness, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from renewscope.functions.scalar import flag, safe_ratio
from renewscope.operators.quantiles import exact_quantiles, quantile_columns, value_ranks
from renewscope.operators.skew import join_unique


def literal_table(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """A one-column table of given values with their position."""
    one = df.sparkSession.range(1)
    return one.select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias("position", name))


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def crosstab_counts(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n), long form: the number of columns may grow with the data."""
    return counts_by(df, row, col)


def crosstab_wide(df: DataFrame, row: str, col: str, levels: Sequence) -> DataFrame:
    """One column per listed level, 0 where a pair does not occur."""
    return df.groupBy(row).pivot(col, list(levels)).agg(F.count(F.lit(1))).fillna(0)


def crosstab_shares(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n, share) with shares summing to 1 within each row value."""
    total = F.sum("n").over(W.partitionBy(row))
    return crosstab_counts(df, row, col).withColumn("share", F.col("n") / total)


def row_totals(df: DataFrame, row: str, col: str) -> DataFrame:
    return crosstab_counts(df, row, col).withColumn("row_total", F.sum("n").over(W.partitionBy(row)))


def missing_fractions(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """(group, column, missing): share of NULLs per group, columns never NULL left out."""
    rates = df.groupBy(group).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    long = rates.unpivot([group], list(cols), "column", "missing")
    worst = F.max("missing").over(W.partitionBy("column"))
    return long.withColumn("_worst", worst).where(F.col("_worst") > 0).drop("_worst")


def describe_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) with exact quartiles."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    long = long.where(F.col("value").isNotNull())
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quart = quantile_columns(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quart, "column")


def grouped_means(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def grouped_medians(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """(group, column, median), exact for groups of any size."""
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [group], list(cols), "column", "value")
    med = exact_quantiles(long, [group, "column"], "value", [0.5])
    return med.select(group, "column", F.col("quantile").alias("median"))


def below_quantile(df: DataFrame, value: str, prob: float) -> DataFrame:
    """Rows strictly below a quantile of the column; NULL rows are dropped."""
    cut = exact_quantiles(df, [], value, [prob]).select("quantile").scalar()
    return df.where(F.col(value) < cut)


def distinct_totals(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows, distinct values of each column and distinct key tuples, exactly."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.countDistinct(c).alias(f"n_{c}") for c in cols],
        F.countDistinct(*keys).alias("n_keys"),
    )


def events_per_user(df: DataFrame) -> DataFrame:
    return counts_by(df, "msno").agg(
        F.avg("n").alias("mean_events"), F.max("n").alias("max_events"), F.count(F.lit(1)).alias("n_users"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int,
              groups: Sequence[str] = (), clip_values: bool = False) -> DataFrame:
    """(groups, bin, left, n): equal-width bins, the last one closed on the right."""
    v = F.col(value).cast("double")
    if clip_values:
        v = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))
    width = (high - low) / bins
    index = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    inside = df.where(v.between(low, high))
    return (
        inside.groupBy(*groups, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("left", F.lit(low) + F.col("bin") * F.lit(width))
    )


def box_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and the outermost values within 1.5 interquartile ranges."""
    q = quantile_columns(df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    # One row per class: classes come from a fixed list.
    fenced = df.join(F.broadcast(q), group)
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - spread, F.col("q3") + spread)
    return fenced.groupBy(group).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
    )


def right_closed_bin(value: Column, edges: Sequence[int]) -> Column:
    """Label '(a, b]' of the bin that holds the value, NULL outside all bins."""
    expr = None
    for a, b in zip(edges, edges[1:]):
        cond, label = (value > a) & (value <= b), F.lit(f"({a}, {b}]")
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def rate_by_threshold(df: DataFrame, value: str, thresholds: Sequence[int]) -> DataFrame:
    """(threshold, rate): share of all rows whose value is known and at most the threshold."""
    long = df.select(value, F.explode(F.array(*[F.lit(int(t)) for t in thresholds])).alias("threshold"))
    return long.groupBy("threshold").agg(
        F.avg(flag(F.col(value) <= F.col("threshold"))).alias("rate"))


def spearman(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(a, b, rho) for every pair of columns over the rows without NULLs.

    Average ranks come from counted values, so ties of any size cost one row each,
    and rows of very common values meet their rank in a broadcast of bounded size.
    """
    whole = df.dropna(subset=list(cols)).select(*key, *[F.col(c).cast("double").alias(c) for c in cols])
    long = whole.unpivot(list(key), list(cols), "column", "value")
    ranks = value_ranks(long, ["column"], "value").select("column", "value", "n", "avg_rank")
    ranked = join_unique(long, ranks, ["column", "value"], "n")
    wide = ranked.groupBy(*key).pivot("column", list(cols)).agg(F.first("avg_rank"))
    pairs = [(a, b) for i, a in enumerate(cols) for b in list(cols)[i:]]
    rho = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("rho")) for a, b in pairs
    ])
    return wide.agg(rho.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def mean_se(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """n_runs and, per value, mean, sample standard deviation and standard error."""
    n = F.count(F.lit(1))
    aggs = [n.alias("n_runs")]
    for v in values:
        sd = F.stddev_samp(v)
        aggs += [F.avg(v).alias(f"{v}_mean"), sd.alias(f"{v}_std"), (sd / F.sqrt(n)).alias(f"{v}_se")]
    return df.groupBy(*groups).agg(*aggs)


def top_levels(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k commonest values, smaller value first on ties: a distributed top-k."""
    return (
        df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(col)).limit(k)
    )


def mix_in_top_levels(df: DataFrame, col: str, label: str, k: int = 8) -> DataFrame:
    """Row-normalised class mix within the k commonest levels; k rows are broadcast."""
    kept = df.join(F.broadcast(top_levels(df, col, k).select(col)), col, "left_semi")
    return crosstab_shares(kept, col, label)


def offset_profile(panel: DataFrame, value: str = "total_secs") -> DataFrame:
    """Per offset: active rows, mean and exact median."""
    base = panel.groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    med = exact_quantiles(panel, ["offset"], value, [0.5]).select("offset", F.col("quantile").alias("median"))
    return base.join(med, "offset")


def active_days_per_event(panel: DataFrame) -> DataFrame:
    per = counts_by(panel, "msno", "E")
    return per.agg(
        F.sum("n").alias("panel_rows"), F.count(F.lit(1)).alias("n_events"),
        F.avg("n").alias("mean_days"), F.max("n").alias("max_days"))


def share_of(df: DataFrame, cond: Column, volume: str) -> DataFrame:
    """Rows and volume of a subgroup, absolute and relative to the whole."""
    n, inside = F.count(F.lit(1)), F.count_if(cond)
    part, whole = F.sum(F.when(cond, F.col(volume))), F.sum(volume)
    return df.agg(
        n.alias("n"), inside.alias("n_sub"), safe_ratio(inside, n).alias("share"),
        safe_ratio(part, whole).alias("volume_share"))


def date_bounds(df: DataFrame, col: str, before: int = 0, after: int = 0) -> DataFrame:
    """One row with the first date less `before` days and the last plus `after`."""
    return df.agg(F.date_sub(F.min(col), before).alias("lo"), F.date_add(F.max(col), after).alias("hi"))


def within_bounds(df: DataFrame, col: str, bounds: DataFrame) -> DataFrame:
    """Rows inside scalar bounds, which Spark computes first and pushes as values."""
    return df.where(F.col(col).between(bounds.select("lo").scalar(), bounds.select("hi").scalar()))
