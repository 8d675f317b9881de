"""User-grouped splits: pure functions of the user, so no user is ever divided."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from renewscope.config import RUN_SEEDS, StudyConfig
from renewscope.functions.scalar import md5_mod, user_uniform


def month_index(events: DataFrame) -> DataFrame:
    """Ordinal of each expiry month among the months present.

    The month list is bounded by the cohort window, so it is numbered on its own and
    broadcast; the events are neither sorted nor gathered.
    """
    months = events.select("expiry_month").distinct()
    order = W.partitionBy(F.lit(0)).orderBy("expiry_month")
    numbered = months.withColumn("month_idx", F.row_number().over(order) - 1)
    return events.join(F.broadcast(numbered), "expiry_month")


def with_fixed_split(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The canonical split; both parts come from one hash of the user."""
    user = F.col("msno")
    held = (md5_mod(user, 1000) < int(cfg.holdout_frac * 1000)).cast("int")
    return (
        month_index(events)
        .withColumn("is_holdout", held)
        .withColumn("user_fold", F.when(F.col("is_holdout") == 1, F.lit(-1))
                    .otherwise(md5_mod(user, cfg.n_folds).cast("int")))
        .withColumn("is_modellable", (F.col("label") != "INSUFFICIENT_DATA").cast("int"))
    )


def run_columns(seed: Column, cfg: StudyConfig) -> dict[str, Column]:
    user = F.col("msno")
    held = user_uniform(user, F.concat_ws(":", F.lit("ho"), seed)) < cfg.holdout_frac
    fold = F.floor(user_uniform(user, F.concat_ws(":", F.lit("fold"), seed)) * cfg.n_folds).cast("int")
    return {
        "is_holdout": held.cast("int"),
        "user_fold": F.when(held, F.lit(-1)).otherwise(fold),
    }


def assign_run_split(events: DataFrame, seed: int, cfg: StudyConfig) -> DataFrame:
    """Fresh holdout and folds of one run."""
    return events.withColumns(run_columns(F.lit(str(seed)), cfg))


def assign_all_run_splits(events: DataFrame, cfg: StudyConfig, seeds: Sequence[int] = RUN_SEEDS) -> DataFrame:
    """All runs at once: one row per event and seed."""
    with_seed = events.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    return with_seed.withColumns(run_columns(F.col("seed").cast("string"), cfg))


def development(events: DataFrame) -> DataFrame:
    return events.where(F.col("is_holdout") == 0)


def holdout(events: DataFrame) -> DataFrame:
    return events.where(F.col("is_holdout") == 1)


def fold_parts(events: DataFrame, fold: int, dev_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(train, validation) of one fold."""
    pool = development(events) if dev_only else events
    pool = pool.where(F.col("user_fold") >= 0)
    return pool.where(F.col("user_fold") != fold), pool.where(F.col("user_fold") == fold)


def fold_roles(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Every development row once per fold, marked train or validation."""
    folds = F.explode(F.sequence(F.lit(0), F.lit(cfg.n_folds - 1))).alias("fold")
    pool = development(events).where(F.col("user_fold") >= 0)
    return pool.select("*", folds).withColumn(
        "role", F.when(F.col("user_fold") == F.col("fold"), F.lit("validation")).otherwise(F.lit("train")))


def walk_forward_roles(events: DataFrame, min_train_months: int = 1) -> DataFrame:
    """Development rows per step t: train up to month t, test on month t + 1.

    A row of month m trains in the steps from m on and tests in step m - 1, so it is
    repeated by the number of steps it serves; steps that lack either part are left out.
    """
    dev = development(events)
    # Number of months: bounded by the cohort window.
    span = events.agg(F.min("month_idx").alias("a"), F.max("month_idx").alias("b"))
    lo, hi = span.select("a").scalar(), span.select("b").scalar()
    steps = F.sequence(F.greatest(F.col("month_idx") - 1, lo), hi - 1)
    roles = (
        dev.where(hi > lo)
        .withColumn("step", F.explode(steps))
        .withColumn("role", F.when(F.col("month_idx") <= F.col("step"), F.lit("train")).otherwise(F.lit("test")))
        .where((F.col("step") - lo + 1) >= min_train_months)
    )
    complete = (
        roles.groupBy("step").agg(F.countDistinct("role").alias("parts"))
        .where(F.col("parts") == 2).select("step")
    )
    return roles.join(F.broadcast(complete), "step", "left_semi")


def walk_forward_parts(events: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one step as plain filters, for fitting one model per step."""
    dev = development(events)
    return dev.where(F.col("month_idx") <= step), dev.where(F.col("month_idx") == step + 1)


def hash_order(seed: int, *cols: str) -> Column:
    """A repeatable pseudo-random order that depends on row content only."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def text_order(seed: int, *cols: str) -> Column:
    """An order like hash_order that any engine with MD5 can repeat: sixty bits of the MD5 of the texts, joined by colons."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long")


def stratified_subsample(df: DataFrame, label: str, n: int, keys: Sequence[str], seed: int, order_by: Callable[..., Column] = hash_order) -> DataFrame:
    """About n rows with the class shares of df; per class max(1, round(n_class * n / total)).

    Rows are taken in hash order, by `order_by`. The hash of the last row taken is found per class
    as an exact order statistic, so no class is sorted in one task.
    """
    buckets = 4096
    order = df.withColumn("_h", order_by(seed, *keys))
    order = order.withColumn("_b", F.shiftrightunsigned(F.col("_h"), 52).cast("int"))
    per_bucket = order.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by_class = W.partitionBy(label)
    running = by_class.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    total = per_bucket.agg(F.sum("_n")).scalar()
    sized = (
        per_bucket.withColumn("_class", F.sum("_n").over(by_class))
        .withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
        .withColumn("_take", F.when(total <= n, F.col("_class")).otherwise(
            F.greatest(F.lit(1), F.least(F.col("_class"), F.bround(F.col("_class") * n / total).cast("long")))))
        .where(F.col("_before") < F.col("_take"))
        .withColumn("_left", F.col("_take") - F.col("_before"))
        .select(label, "_b", "_n", "_left")
    )
    # At most classes x buckets rows: a fixed bound.
    kept = order.join(F.broadcast(sized), [label, "_b"])
    whole = kept.where(F.col("_left") >= F.col("_n"))
    edge = kept.where(F.col("_left") < F.col("_n"))
    in_edge = W.partitionBy(label, "_b").orderBy("_h", *keys)
    edge = edge.withColumn("_r", F.row_number().over(in_edge)).where(F.col("_r") <= F.col("_left"))
    return whole.unionByName(edge.drop("_r")).select(*df.columns)


def hash_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int, order_by: Callable[..., Column] = hash_order) -> DataFrame:
    """n rows in hash order: the sampling operator itself, a distributed top-n."""
    return df.orderBy(order_by(seed, *keys), *keys).limit(n)


def split_leaks(events: DataFrame) -> DataFrame:
    """Users found in more than one fold; must be empty."""
    return (
        events.groupBy("msno").agg(F.countDistinct("user_fold").alias("folds"))
        .where(F.col("folds") > 1)
    )
