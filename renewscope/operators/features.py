"""Model inputs: projection with a leak guard, encoding, imputation, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from renewscope.config import StudyConfig
from renewscope.functions.scalar import category_text, day_number, keep_between
from renewscope.operators.quantiles import exact_quantiles
from renewscope.sources.contract import CATEGORICAL, FeatureContract


def project_features(df: DataFrame, contract: FeatureContract, cfg: StudyConfig, feature_set: str = "base",
                     keep: Sequence[str] = ()) -> DataFrame:
    """Select a feature set; refuse it when a leaking column is in it.

    The registration date becomes days since the epoch and implausible ages NULL.
    """
    names = contract.feature_list(feature_set)
    contract.assert_no_leak(names)
    cols = []
    for c in names:
        if c == "registration_init_time":
            cols.append(day_number(F.col(c)).cast("double").alias(c))
        elif c == "bd":
            cols.append(keep_between(F.col(c), *cfg.age_use).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*[k for k in keep if k not in names], *cols)


def categorical_columns(names: Sequence[str]) -> list[str]:
    return [c for c in names if c in CATEGORICAL]


def numeric_columns(names: Sequence[str]) -> list[str]:
    return [c for c in names if c not in CATEGORICAL]


def fit_medians(dev: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, median) over the development rows, exact for any number of rows."""
    long = dev.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    return exact_quantiles(long, ["column"], "value", [0.5]).select("column", F.col("quantile").alias("median"))


def impute_medians(df: DataFrame, medians: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace NULLs by fitted medians; the fitted table has one row per column."""
    fitted = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median"))).alias("m")).scalar()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.try_element_at(F.col("_m"), F.lit(c))) for c in cols}
    return df.withColumn("_m", fitted).withColumns(filled).drop("_m")


def fit_scaling(dev: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mean, std): population standard deviation plus 1e-6."""
    row = dev.agg(*[x for i, c in enumerate(cols) for x in (
        F.avg(c).alias(f"m{i}"), (F.stddev_pop(c) + 1e-6).alias(f"s{i}"))])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
                      for i, c in enumerate(cols)])
    return row.select(F.explode(parts).alias("p")).select("p.*")


def standardise(df: DataFrame, scaling: DataFrame, cols: Sequence[str]) -> DataFrame:
    fitted = scaling.agg(F.map_from_entries(F.collect_list(
        F.struct("column", F.struct("mean", "std")))).alias("m")).scalar()
    scaled = {c: (F.col(c) - F.col("_s")[c]["mean"]) / F.col("_s")[c]["std"] for c in cols}
    return df.withColumn("_s", fitted).withColumns(scaled).drop("_s")


def level_table(df: DataFrame, col: str) -> DataFrame:
    """(level, code): levels in text order. Categories come from code lists of the
    source, so their number does not grow with the rows."""
    levels = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("level")).distinct()
    order = W.partitionBy(F.lit(0)).orderBy("level")
    return levels.withColumn("code", F.row_number().over(order) - 1)


def encode_levels(df: DataFrame, col: str, levels: DataFrame, out: str) -> DataFrame:
    """Code of each value; NULL and unseen values take the next free code."""
    reserved = levels.agg(F.coalesce(F.max("code") + 1, F.lit(0))).scalar()
    joined = df.join(levels.withColumnRenamed("code", "_code"), df[col].cast("string") == levels["level"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_code"), reserved)).drop("_code", "level")


def fixed_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, levels): all levels of each column in text order, 'NA' for missing."""
    long = df.select(*[category_text(F.col(c)).alias(c) for c in cols]).unpivot([], list(cols), "column", "level")
    return long.distinct().groupBy("column").agg(F.array_sort(F.collect_list("level")).alias("levels"))


def group_rare_levels(df: DataFrame, col: str, out: str, min_rows: int = 50, fit_on: DataFrame | None = None) -> DataFrame:
    """Levels with fewer than `min_rows` fitted rows become one level 'infrequent'."""
    counts = (fit_on if fit_on is not None else df).groupBy(category_text(F.col(col)).alias("_level")).agg(
        F.count(F.lit(1)).alias("_rows"))
    frequent = counts.where(F.col("_rows") >= min_rows).select("_level")
    named = df.withColumn("_level", category_text(F.col(col)))
    kept = named.join(frequent.withColumn("_hit", F.lit(1)), "_level", "left")
    return kept.withColumn(out, F.when(F.col("_hit") == 1, F.col("_level")).otherwise(F.lit("infrequent"))).drop(
        "_level", "_hit")


def one_hot_stages(cols: Sequence[str]) -> list:
    """ML stages: index (unknown kept apart) and one-hot each column to `<col>_vec`."""
    index = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep",
                          stringOrderType="alphabetAsc")
    return [index, OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_vec" for c in cols],
                                  handleInvalid="keep", dropLast=True)]


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * n_class)."""
    whole = W.partitionBy(F.lit(0))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(
        label, (F.sum("_n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("_n"))).alias("weight"))


def with_balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """One weight per class; classes come from a fixed list, so the table is tiny."""
    return df.join(F.broadcast(balanced_weights(df, label)), label)
