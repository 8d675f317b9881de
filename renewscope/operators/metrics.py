"""Scores from confusion counts: one pass over the predictions, then tiny tables.

Predictions are rows with integer columns `y` (truth) and `p` (predicted class), and
any grouping columns such as seed or model.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from renewscope.config import TAU_GRID, StudyConfig
from renewscope.functions.scalar import argmax_index, name_of, safe_ratio
from renewscope.operators.explore import mean_se
from renewscope.operators.quantiles import STEPS, value_bucket


def confusion(pred: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*groups, "y", "p").agg(F.count(F.lit(1)).alias("n"))


def class_counts(conf: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, cls, support, predicted, hits) for classes seen as truth or prediction."""
    zero = F.lit(0).cast("long")
    sides = F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero).alias("hits")),
        F.struct(F.col("p").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("hits")),
    ))
    long = conf.select(*groups, sides.alias("s")).select(*groups, "s.*")
    return long.groupBy(*groups, "cls").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))


def _f1() -> Column:
    return 2 * F.col("hits") / (F.col("support") + F.col("predicted"))


def scores_from_confusion(conf: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """accuracy, balanced_acc, macro_f1, weighted_f1 and n per group."""
    per = class_counts(conf, groups).withColumn("f1", _f1()).withColumn(
        "recall", safe_ratio(F.col("hits"), F.col("support")))
    n = F.sum("support")
    return per.groupBy(*groups).agg(
        (F.sum("hits") / n).alias("accuracy"), F.avg("recall").alias("balanced_acc"),
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        n.alias("n"))


def score_block(pred: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return scores_from_confusion(confusion(pred, groups), groups)


def _grid(df: DataFrame, groups: Sequence[str], names: Sequence[Column], size: int) -> DataFrame:
    """Every group with every class code, from the groups present in df."""
    codes = F.sequence(F.lit(0), F.lit(size - 1))
    out = df.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
    for name in names:
        out = out.select("*", F.explode(codes).alias(name))
    return out


def per_class_report(pred: DataFrame, classes: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, cls, class, precision, recall, f1, support) on the full class list;
    an undefined score is 0."""
    counts = class_counts(confusion(pred, groups), groups)
    full = _grid(counts, groups, ["cls"], len(classes)).join(counts, [*groups, "cls"], "left")
    full = full.fillna(0, ["support", "predicted", "hits"])
    zero = F.lit(0.0)
    return full.select(
        *groups, "cls", name_of(F.col("cls"), classes).alias("class"),
        F.coalesce(safe_ratio(F.col("hits"), F.col("predicted")), zero).alias("precision"),
        F.coalesce(safe_ratio(F.col("hits"), F.col("support")), zero).alias("recall"),
        F.coalesce(safe_ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")), zero).alias("f1"),
        "support", "hits",
    )


def classification_report(pred: DataFrame, classes: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Per-class rows followed by accuracy, macro and weighted averages."""
    per = per_class_report(pred, classes, groups)
    total = F.sum("support")
    metrics = ("precision", "recall", "f1")
    macro = per.groupBy(*groups).agg(*[F.avg(m).alias(m) for m in metrics], total.alias("support"))
    weighted = per.groupBy(*groups).agg(
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in metrics], total.alias("support"))
    accuracy = per.groupBy(*groups).agg((F.sum("hits") / total).alias("_a"), total.alias("support"))
    accuracy = accuracy.select(*groups, *[F.col("_a").alias(m) for m in metrics], "support")
    rows = per.select(*groups, "class", *metrics, "support")
    for label, part in (("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)):
        rows = rows.unionByName(part.withColumn("class", F.lit(label)))
    return rows


def confusion_matrix(pred: DataFrame, size: int, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, y, p, n, share): the full grid, share normalised by true class."""
    conf = confusion(pred, groups)
    full = _grid(conf, groups, ["y", "p"], size).join(conf, [*groups, "y", "p"], "left").fillna(0, ["n"])
    total = F.sum("n").over(W.partitionBy(*groups, "y"))
    return full.withColumn("share", F.coalesce(safe_ratio(F.col("n"), total), F.lit(0.0)))


def confusion_mean_se(pred: DataFrame, size: int, run: str = "seed") -> DataFrame:
    """(y, p) cells with mean and standard error of the row-normalised share over runs."""
    return mean_se(confusion_matrix(pred, size, [run]), ["y", "p"], ["share"])


def _running_positives(df: DataFrame, score: str, positive: str, groups: Sequence[str]) -> DataFrame:
    """Per distinct score: rows and positives at it, below it and in all.

    Scores are ordered inside buckets, and running totals over buckets supply the rest,
    so no task ever orders all scores.
    """
    groups = list(groups)
    counts = (
        df.groupBy(*groups, F.col(score).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(positive).cast("long")).alias("pos"))
        .withColumn("_b", value_bucket(F.col("_v"), STEPS))
    )
    whole = W.partitionBy(*groups, F.lit(0))
    upto = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    buckets = counts.groupBy(*groups, "_b").agg(F.sum("n").alias("_bn"), F.sum("pos").alias("_bp"))
    buckets = buckets.select(
        *[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)], F.col("_b").alias("_kb"),
        (F.sum("_bn").over(upto) - F.col("_bn")).alias("_n0"), (F.sum("_bp").over(upto) - F.col("_bp")).alias("_p0"),
        F.sum("_bn").over(whole).alias("n_all"), F.sum("_bp").over(whole).alias("pos_all"))
    cond = [F.col("_b") == F.col("_kb")] + [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(groups)]
    inside = W.partitionBy(*groups, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.join(buckets, cond).select(
        *groups, F.col("_v").alias("score"), "n", "pos", "n_all", "pos_all",
        (F.col("_n0") + F.sum("n").over(inside) - F.col("n")).alias("n_below"),
        (F.col("_p0") + F.sum("pos").over(inside) - F.col("pos")).alias("pos_below"))


def ranking_scores(df: DataFrame, score: str, positive: str, groups: Sequence[str] = ()) -> DataFrame:
    """roc_auc (ties count half) and average_precision (step-wise) of a score."""
    at = _running_positives(df, score, positive, groups)
    neg, neg_below = F.col("n") - F.col("pos"), F.col("n_below") - F.col("pos_below")
    won = F.sum(F.col("pos") * (neg_below + neg / 2.0))
    pos_all, neg_all = F.first("pos_all"), F.first("n_all") - F.first("pos_all")
    above = F.col("n_all") - F.col("n_below")
    hits = F.col("pos_all") - F.col("pos_below")
    return at.groupBy(*groups).agg(
        safe_ratio(won, (pos_all * neg_all)).alias("roc_auc"),
        safe_ratio(F.sum(F.col("pos") * hits / above), pos_all).alias("average_precision"))


def rmse(df: DataFrame, truth: str, pred: str, groups: Sequence[str] = ()) -> DataFrame:
    err = F.col(truth) - F.col(pred)
    return df.groupBy(*groups).agg(F.sqrt(F.avg(err * err)).alias("rmse"))


def compose_probabilities(p_renew: Column, movement: Column) -> Column:
    """[1 - p, p*q1, p*q2, p*q3]: four-class probabilities from the two stages."""
    return F.concat(F.array(1 - p_renew), F.transform(movement, lambda q: p_renew * q))


def weighted_argmax(probs: Column, weights: Column) -> Column:
    return argmax_index(F.zip_with(probs, weights, lambda p, w: p * w))


def threshold_class(p_renew: Column, movement_code: Column, tau) -> Column:
    """Class 0 (churn) below the threshold, else the movement class shifted by one."""
    return F.when(p_renew < tau, F.lit(0)).otherwise(movement_code + 1)


def tau_scores(pred: DataFrame, taus: Sequence[float] = TAU_GRID, groups: Sequence[str] = ()) -> DataFrame:
    """Scores of every renewal threshold over (y, p_renew, movement).

    A row's prediction changes once, at the first threshold above p_renew. Counting
    rows by (truth, movement, that position) gives all thresholds from one pass and a
    table of fixed size instead of one copy of the data per threshold.
    """
    grid = F.array(*[F.lit(float(t)) for t in taus])
    first_above = F.size(F.filter(grid, lambda t: t <= F.col("p_renew")))
    cells = pred.groupBy(*groups, "y", "movement", first_above.alias("_at")).agg(F.count(F.lit(1)).alias("n"))
    wide = cells.select("*", F.posexplode(grid).alias("_i", "tau"))
    conf = wide.groupBy(*groups, "tau", "y", F.when(F.col("_i") >= F.col("_at"), F.lit(0))
                        .otherwise(F.col("movement") + 1).alias("p")).agg(F.sum("n").alias("n"))
    return scores_from_confusion(conf, [*groups, "tau"])


def best_tau(pred: DataFrame, taus: Sequence[float] = TAU_GRID, groups: Sequence[str] = ()) -> DataFrame:
    """The threshold with the best macro-F1, the lowest one on ties."""
    scored = tau_scores(pred, taus, groups)
    return scored.groupBy(*groups).agg(
        F.max_by("tau", F.struct("macro_f1", -F.col("tau"))).alias("tau"), F.max("macro_f1").alias("macro_f1"))


def weight_scores(pred: DataFrame, weights: Sequence[Sequence[float]], groups: Sequence[str] = ()) -> DataFrame:
    """Macro-F1 of arg-max over probs * w for every weight vector, by its position.

    Rows are not copied for each vector: a task counts (truth, class) for all vectors over
    its rows, and only these counts leave it.
    """
    table = np.asarray(weights, np.float64)
    size = table.shape[1]

    def count(batches):
        for part in (b.slice(k, 2048) for b in batches for k in range(0, b.num_rows, 2048)):
            keys = list(zip(*[part.column(i).to_pylist() for i in range(len(groups))])) if groups else [()] * part.num_rows
            truth = part.column(len(groups)).to_numpy(zero_copy_only=False).astype(np.int64)
            probs = part.column(len(groups) + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for key in dict.fromkeys(keys):
                own = np.array([k == key for k in keys])
                counts = np.zeros((len(table), size * size), np.int64)
                for at in range(0, len(table), 256):
                    best = (table[at : at + 256, None, :] * probs[None, own, :]).argmax(axis=2)
                    cell = truth[own][None, :] * size + best
                    cell += np.arange(len(cell))[:, None] * size * size
                    counts[at : at + 256] = np.bincount(cell.ravel(), minlength=len(best) * size * size).reshape(len(best), -1)
                vector, cell = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(vector), part.schema.field(i).type) for i, k in enumerate(key)]
                    + [pa.array(x, pa.int32()) for x in (vector, cell // size, cell % size)] + [pa.array(counts[vector, cell])],
                    [*groups, "weight_id", "y", "p", "n"])

    kinds = "".join(f"`{g}` {pred.schema[g].dataType.simpleString()}, " for g in groups)
    counted = pred.select(*groups, "y", "probs").mapInArrow(count, kinds + "weight_id int, y int, p int, n long")
    conf = counted.groupBy(*groups, "weight_id", "y", "p").agg(F.sum("n").alias("n"))
    return scores_from_confusion(conf, [*groups, "weight_id"])


def best_weights(pred: DataFrame, weights: Sequence[Sequence[float]], groups: Sequence[str] = ()) -> DataFrame:
    scored = weight_scores(pred, weights, groups)
    return scored.groupBy(*groups).agg(
        F.max_by("weight_id", F.struct("macro_f1", -F.col("weight_id"))).alias("weight_id"),
        F.max("macro_f1").alias("macro_f1"))


def ratio_from_prediction(pred: Column, pre_secs: Column, arm: str) -> Column:
    """Predicted volume ratio of either regression arm."""
    if arm == "volume":
        return F.expm1(pred) / F.greatest(pre_secs, F.lit(1e-9))
    if arm == "ratio":
        return F.expm1(pred)
    raise ValueError(f"unknown arm {arm!r}")


def ratio_to_movement(ratio: Column, cfg: StudyConfig) -> Column:
    """0 contraction, 1 stable, 2 expansion."""
    return F.when(ratio < cfg.vol_low, F.lit(0)).when(ratio > cfg.vol_high, F.lit(2)).otherwise(F.lit(1))


def ensemble_mean(members: DataFrame, keys: Sequence[str], probs: str = "probs") -> DataFrame:
    """Mean probability vector over the members of each row."""
    long = members.select(*keys, F.posexplode(probs).alias("cls", "q"))
    mean = long.groupBy(*keys, "cls").agg(F.avg("q").alias("q"))
    return mean.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cls", "q"))), lambda s: s["q"]).alias("probs"))


def majority_class(train: DataFrame) -> DataFrame:
    """One row: the commonest class, the lowest code on ties."""
    return train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max_by("y", F.struct("n", -F.col("y"))).alias("p"))


def baseline_predictions(train: DataFrame, test: DataFrame, uniform: Column) -> DataFrame:
    """(strategy, y, p) of the naive baselines on the test rows.

    `uniform` is a value in [0, 1) that depends on the row alone; the stratified
    baseline compares it with the cumulative class shares of the training rows.
    """
    shares = train.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(F.lit(0)).orderBy("y")
    upto = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(W.partitionBy(F.lit(0)))
    bounds = shares.withColumn("upto", upto).agg(
        F.array_sort(F.collect_list(F.struct("upto", "y"))).alias("b")).select("b").scalar()
    major = majority_class(train).select("p").scalar()
    drawn = test.select("y", uniform.alias("u")).withColumn("_b", bounds)
    stratified = drawn.select(
        F.lit("stratified").alias("strategy"), "y",
        F.element_at(F.filter("_b", lambda s: s["upto"] > F.col("u")), 1)["y"].alias("p"))
    constant = test.select(F.explode(F.array(F.lit("most_frequent"), F.lit("prior"))).alias("strategy"), "y")
    return constant.withColumn("p", major).unionByName(stratified)


def importance_shares(imp: DataFrame) -> DataFrame:
    """Adds the within-run share and rank of each feature; rank 1 is the largest share,
    equal shares take the smallest rank."""
    by_run = W.partitionBy("run")
    return imp.withColumn("gain_share", F.col("gain") / F.sum("gain").over(by_run)).withColumn(
        "rank", F.rank().over(by_run.orderBy(F.desc("gain"))))


def importance_robustness(shares: DataFrame) -> DataFrame:
    """Across runs: mean, spread and median share, mean rank, top-5 and top-10 counts."""
    sd = F.stddev_samp("gain_share")
    return shares.groupBy("feature").agg(
        F.avg("gain_share").alias("mean_share"), sd.alias("sd_share"),
        (sd / F.sqrt(F.count(F.lit(1)))).alias("se_share"), F.median("gain_share").alias("median_share"),
        F.avg("rank").alias("mean_rank"), F.count_if(F.col("rank") <= 5).alias("top5_count"),
        F.count_if(F.col("rank") <= 10).alias("top10_count"), F.count(F.lit(1)).alias("n_runs"))


def importance_overlap(shares: DataFrame, run, k: int = 10) -> DataFrame:
    """How many of one run's top k are among the top k by mean share."""
    one = shares.where(F.col("run") == run).orderBy(F.desc("gain_share"), "feature").limit(k).select("feature")
    mean = importance_robustness(shares).orderBy(F.desc("mean_share"), "feature").limit(k).select("feature")
    return one.intersect(mean).agg(F.count(F.lit(1)).alias("overlap"))


def in_every_run(robust: DataFrame) -> DataFrame:
    return robust.where(F.col("top10_count") == F.col("n_runs")).select("feature")


def champion(runs: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """The model with the best mean score; the first name on ties."""
    mean = runs.groupBy("model").agg(F.avg(metric).alias("m")).orderBy(F.desc("m"), "model").limit(1)
    return mean.select("model", F.col("m").alias(f"{metric}_mean"))


def runs_wide(runs: DataFrame, models: Sequence[str], metric: str = "macro_f1") -> DataFrame:
    """One row per seed, one column per model, matched by seed."""
    return runs.groupBy("seed").pivot("model", list(models)).agg(F.first(metric))


def leaderboard(*tables: DataFrame, metrics: Sequence[str] = ("macro_f1", "balanced_acc", "accuracy", "weighted_f1"),
                ) -> DataFrame:
    """Result tables with either `metric` or `metric_mean` columns, best macro-F1 first."""
    rows = None
    for t in tables:
        cols = [F.coalesce(*[F.col(c) for c in (f"{m}_mean", m) if c in t.columns]).alias(m) for m in metrics]
        part = t.select("model", *cols)
        rows = part if rows is None else rows.unionByName(part)
    return rows.orderBy(F.desc(metrics[0]), "model")


def sum_to_one(shares: DataFrame) -> DataFrame:
    """(run, total, ok): shares of a run must add up to 1."""
    return shares.groupBy("run").agg(F.sum("gain_share").alias("total")).withColumn(
        "ok", (F.abs(F.col("total") - 1) <= 1e-6).cast("int"))
