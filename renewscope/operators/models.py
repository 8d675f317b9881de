"""Model families on Spark ML and the evaluation protocols around them.

Fitting loops run on the driver over a handful of folds, seeds or steps; all data work
and scoring stays in Spark and every protocol returns one small result table.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewscope.config import MODEL_CLASSES, MOVEMENT_CLASSES, StudyConfig
from renewscope.functions.scalar import argmax_index, category_text, code_of
from renewscope.operators import metrics as M
from renewscope.operators.features import (
    categorical_columns, numeric_columns, one_hot_stages, project_features, with_balanced_weights,
)
from renewscope.operators.splits import assign_run_split, development, fold_parts, holdout, walk_forward_parts
from renewscope.sources.contract import FeatureContract

KEYS = ("msno", "E")
CARRIED = (*KEYS, "label", "renewed", "vol_ratio", "post_total_secs", "user_fold", "is_holdout", "month_idx")


def model_table(events: DataFrame, contract: FeatureContract, cfg: StudyConfig, feature_set: str = "base",
                extra: Sequence[str] = ()) -> DataFrame:
    """Modellable rows with numeric features as doubles, categories as text and targets
    `y` (four classes), `renew` and `move` (three classes, renewers only)."""
    rows = events.where(F.col("label") != "INSUFFICIENT_DATA")
    keep = [c for c in dict.fromkeys([*CARRIED, *extra]) if c in events.columns]
    names = contract.feature_list(feature_set)
    frame = project_features(rows, contract, cfg, feature_set, keep)
    return frame.withColumns({
        **{c: F.col(c).cast("double") for c in numeric_columns(names)},
        **{c: category_text(F.col(c)) for c in categorical_columns(names)},
        "y": code_of(F.col("label"), MODEL_CLASSES).cast("double"),
        "renew": F.col("renewed").cast("double"),
        "move": code_of(F.col("label"), MOVEMENT_CLASSES).cast("double"),
        "pre_secs": F.col("pre_total_secs").cast("double"),
    })


def _numeric(nums: Sequence[str], scaled: bool) -> list:
    """Median imputation and assembly. Medians inside a fit are within 0.1 % of rank;
    fit_medians gives exact ones where they are wanted."""
    filled = [f"{c}_filled" for c in nums]
    stages = [Imputer(strategy="median", inputCols=list(nums), outputCols=filled),
              VectorAssembler(inputCols=filled, outputCol="numbers")]
    return stages + ([StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)] if scaled else [])


class RareLevels(Estimator):
    """Categories seen in fewer than `least` fitted rows, and those beyond the `most` commonest ones,
    become one level. Levels come from code lists, so the kept ones fit the plan."""

    def __init__(self, cols: Sequence[str], least: int = 50, most: int = 120):
        super().__init__()
        self.cols, self.least, self.most = list(cols), least, most

    def _fit(self, dataset: DataFrame) -> KeptLevels:
        kept = {}
        for c in self.cols:
            counted = dataset.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= self.least) & F.col(c).isNotNull())
            kept[c] = [r[0] for r in counted.orderBy(F.desc("n"), c).limit(self.most).collect()]
        return KeptLevels(kept)


class KeptLevels(Transformer):
    def __init__(self, kept: dict[str, list[str]]):
        super().__init__()
        self.kept = kept

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({
            c: F.when(F.col(c).isin(levels), F.col(c)).otherwise(F.lit("infrequent")) if levels else F.lit("infrequent")
            for c, levels in self.kept.items()})


def logistic(names: Sequence[str], target: str = "y", max_iter: int = 300, reg: float = 0.0) -> Pipeline:
    """Impute, scale, one-hot, balanced multinomial logistic regression."""
    nums, cats = numeric_columns(names), categorical_columns(names)
    stages = _numeric(nums, scaled=True) + ([RareLevels(cats), *one_hot_stages(cats)] if cats else [])
    stages += [VectorAssembler(inputCols=["scaled", *[f"{c}_vec" for c in cats]], outputCol="x"),
               LogisticRegression(featuresCol="x", labelCol=target, weightCol="weight", family="multinomial",
                                  maxIter=max_iter, regParam=reg)]
    return Pipeline(stages=stages)


def _tree_inputs(names: Sequence[str]) -> list:
    nums, cats = numeric_columns(names), categorical_columns(names)
    index = [RareLevels(cats), StringIndexer(inputCols=cats, outputCols=[f"{c}_idx" for c in cats], handleInvalid="keep")] if cats else []
    return _numeric(nums, scaled=False) + index + [
        VectorAssembler(inputCols=["numbers", *[f"{c}_idx" for c in cats]], outputCol="x")]


def forest(names: Sequence[str], target: str = "y", trees: int = 200, leaf: int = 20, depth: int = 12,
           seed: int = 42) -> Pipeline:
    return Pipeline(stages=_tree_inputs(names) + [RandomForestClassifier(
        featuresCol="x", labelCol=target, weightCol="weight", numTrees=trees, minInstancesPerNode=leaf,
        maxDepth=depth, maxBins=128, seed=seed)])


def boosted(names: Sequence[str], target: str = "y", rounds: int = 400, depth: int = 6, step: float = 0.05,
            seed: int = 42) -> Pipeline:
    """Boosted trees, one ensemble per class; two classes need just one."""
    gbt = GBTClassifier(featuresCol="x", labelCol=target, weightCol="weight", maxIter=rounds, maxDepth=depth,
                        stepSize=step, maxBins=128, seed=seed)
    head = gbt if target == "renew" else OneVsRest(classifier=gbt, featuresCol="x", labelCol=target, weightCol="weight")
    return Pipeline(stages=[*_tree_inputs(names), head])


def boosted_regression(names: Sequence[str], target: str, rounds: int = 400, depth: int = 6, step: float = 0.05,
                       seed: int = 42) -> Pipeline:
    return Pipeline(stages=_tree_inputs(names) + [GBTRegressor(
        featuresCol="x", labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=step, maxBins=128, seed=seed)])


def importances(fitted, names: Sequence[str], run: int) -> list[tuple[int, str, float]]:
    """(run, feature, gain) of a fitted tree pipeline; one-vs-rest ensembles are averaged."""
    head = fitted.stages[-1]
    parts = [m.featureImportances.toArray() for m in getattr(head, "models", [head])]
    order = [*numeric_columns(names), *categorical_columns(names)]  # as the assembler lists them
    return [(run, feature, float(sum(p[i] for p in parts) / len(parts))) for i, feature in enumerate(order)]


def importance_runs(rows: DataFrame, make: Maker, names: Sequence[str], cfg: StudyConfig, seeds: Sequence[int]) -> DataFrame:
    """(run, feature, gain): one fit per seed on its development rows."""
    found = [row for seed in seeds for row in importances(fit_balanced(make(), development(assign_run_split(rows, seed, cfg))), names, seed)]
    return rows.sparkSession.createDataFrame(found, "run int, feature string, gain double")


def fit_balanced(pipeline: Pipeline, train: DataFrame, target: str = "y"):
    return pipeline.fit(with_balanced_weights(train.where(F.col(target).isNotNull()), target))


def class_probabilities(scored: DataFrame, out: str) -> DataFrame:
    """The probability vector; one-vs-rest margins pass through a logistic first."""
    if "probability" in scored.columns:
        return scored.withColumn(out, vector_to_array("probability"))
    odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn(out, F.transform(odds, lambda q: q / total))


def predict(model, rows: DataFrame, target: str = "y") -> DataFrame:
    """Rows with integer truth `y` and prediction `p` of a target."""
    scored = model.transform(rows)
    return scored.select(*[c for c in CARRIED if c in scored.columns],
                         F.col(target).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


Maker = Callable[[], Pipeline]


def fold_predictions(rows: DataFrame, make: Maker, target: str = "y", folds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Out-of-fold predictions with their fold number."""
    parts = []
    for k in folds:
        train, val = fold_parts(rows, k)
        parts.append(predict(fit_balanced(make(), train, target), val.where(F.col(target).isNotNull()), target)
                     .withColumn("fold", F.lit(k)))
    return union_all(parts)


def cross_validate(rows: DataFrame, makers: dict[str, Maker], target: str = "y",
                   folds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(model, macro_f1, macro_f1_std, balanced_acc): mean and population spread over folds."""
    parts = [fold_predictions(rows, make, target, folds).withColumn("model", F.lit(name))
             for name, make in makers.items()]
    scored = M.score_block(union_all(parts), ["model", "fold"])
    return scored.groupBy("model").agg(
        F.avg("macro_f1").alias("macro_f1"), F.stddev_pop("macro_f1").alias("macro_f1_std"),
        F.avg("balanced_acc").alias("balanced_acc"))


def draw_configs(grid: dict[str, Sequence], n: int, seed: int) -> list[dict]:
    """Seeded independent draws from a grid."""
    rng = random.Random(seed)
    return [{k: rng.choice(list(v)) for k, v in grid.items()} for _ in range(n)]


def random_search(rows: DataFrame, make: Callable[..., Pipeline], grid: dict[str, Sequence], n: int, seed: int,
                  target: str = "y", folds: Sequence[int] = (0, 1, 2), store=None, name: str = "sweep",
                  force: bool = False) -> tuple[dict, DataFrame]:
    """Best parameters and the trial table; a stored sweep is reused unless forced."""
    if store is not None and store.has(name) and not force:
        return store.load(name)["best_params"], store.trials(name)
    configs = draw_configs(grid, n, seed)
    makers = {f"{i:04d}": (lambda c=c: make(**c)) for i, c in enumerate(configs)}
    scored = cross_validate(rows, makers, target, folds).withColumnRenamed("model", "trial")
    # One column per parameter, looked up by trial number.
    drawn = {k: F.create_map(*[x for i, c in enumerate(configs) for x in (F.lit(f"{i:04d}"), F.lit(c[k]))])[F.col("trial")]
             for k in grid}
    trials = scored.withColumns(drawn)
    if store is not None:
        store.save(name, trials, list(grid), seed=seed, n_trials=n, cv_folds=len(folds))
        return store.load(name)["best_params"], store.trials(name)
    best = trials.orderBy(F.desc("macro_f1"), "trial").first()
    return {k: best[k] for k in grid}, trials


def repeated_holdout(rows: DataFrame, makers: dict[str, Maker], cfg: StudyConfig, seeds: Sequence[int],
                     tune: Callable[[DataFrame, int], dict[str, Maker]] | None = None) -> DataFrame:
    """(seed, model, scores): fresh user split per seed, optional tuning on its development
    rows, refit on all of them, one evaluation on its holdout."""
    parts = []
    for seed in seeds:
        run = assign_run_split(rows, seed, cfg)
        dev, held = development(run), holdout(run)
        for name, make in (tune(dev, seed) if tune else makers).items():
            parts.append(predict(fit_balanced(make(), dev), held).withColumns(
                {"seed": F.lit(seed), "model": F.lit(name)}))
    return M.score_block(union_all(parts), ["seed", "model"])


def two_stage_scores(train: DataFrame, test: DataFrame, renew: Maker, move: Maker) -> DataFrame:
    """Test rows with p_renew and the movement vector; stage two learns from renewers."""
    first = fit_balanced(renew(), train, "renew")
    second = fit_balanced(move(), train.where(F.col("renewed") == 1), "move")
    kept = [c for c in test.columns]
    one = class_probabilities(first.transform(test), "_r").select(*kept, F.col("_r")[1].alias("p_renew"))
    two = class_probabilities(second.transform(one), "q")
    return two.select(*kept, "p_renew", "q").withColumn("movement", argmax_index(F.col("q"))).withColumn(
        "y", F.col("y").cast("int"))


def out_of_fold(rows: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame],
                folds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    return union_all([score(*fold_parts(rows, k)) for k in folds])


def two_stage_runs(rows: DataFrame, renew: Maker, move: Maker, cfg: StudyConfig, seeds: Sequence[int],
                   folds: Sequence[int] | None = None) -> DataFrame:
    """(seed, model, best_tau, scores) of the arg-max and the tuned two-stage classifier; the
    threshold is learned from out-of-fold predictions of all folds."""
    parts, folds = [], range(cfg.n_folds) if folds is None else folds
    score = lambda train, test: two_stage_scores(train, test, renew, move)
    for seed in seeds:
        run = assign_run_split(rows, seed, cfg)
        dev, held = development(run), holdout(run)
        tau = M.best_tau(out_of_fold(dev, score, folds)).first()["tau"]
        scored = score(dev, held)
        probs = M.compose_probabilities(F.col("p_renew"), F.col("q"))
        both = F.explode(F.array(
            F.struct(F.lit("argmax").alias("model"), argmax_index(probs).alias("p")),
            F.struct(F.lit("tuned").alias("model"),
                     M.threshold_class(F.col("p_renew"), F.col("movement"), F.lit(tau)).alias("p"))))
        parts.append(scored.select("y", both.alias("m")).select(
            "y", "m.model", "m.p", F.lit(seed).alias("seed"), F.lit(tau).alias("best_tau")))
    return M.score_block(union_all(parts), ["seed", "model", "best_tau"])


def stage_one_quality(rows: DataFrame, renew: Maker) -> DataFrame:
    """Ranking scores and macro-F1 at 0.5 of the renewal stage on held-out users."""
    model = fit_balanced(renew(), development(rows), "renew")
    scored = class_probabilities(model.transform(holdout(rows)), "_r").select(
        F.col("renewed").cast("int").alias("y"), F.col("_r")[1].alias("score"))
    ranked = M.ranking_scores(scored, "score", "y")
    block = M.score_block(scored.withColumn("p", (F.col("score") >= 0.5).cast("int")))
    return ranked.select("*", block.select("macro_f1").scalar().alias("macro_f1"))


def regression_target(arm: str):
    source = "post_total_secs" if arm == "volume" else "vol_ratio"
    return F.log1p(F.greatest(F.col(source).cast("double"), F.lit(0.0)))


def regression_arm(train: DataFrame, test: DataFrame, names: Sequence[str], arm: str, cfg: StudyConfig,
                   **params) -> DataFrame:
    """Test rows with the regressed target, its prediction and the derived movement."""
    renewers = train.where(F.col("renewed") == 1).withColumn("_t", regression_target(arm)).where(F.col("_t").isNotNull())
    model = boosted_regression(names, "_t", **params).fit(renewers)
    scored = model.transform(test.withColumn("target", regression_target(arm)))
    ratio = M.ratio_from_prediction(F.col("prediction"), F.col("pre_secs"), arm)
    return scored.select(*test.columns, "target", "prediction").withColumn(
        "movement", M.ratio_to_movement(ratio, cfg))


def regression_cv(rows: DataFrame, names: Sequence[str], cfg: StudyConfig, arms: Sequence[str] = ("volume", "ratio"),
                  folds: Sequence[int] = (0, 1, 2), **params) -> DataFrame:
    """(arm, move_f1, move_f1_std, rmse) over user-grouped folds of the renewers."""
    renewers = rows.where(F.col("renewed") == 1)
    parts = []
    for arm in arms:
        for k in folds:
            train, val = fold_parts(renewers, k)
            parts.append(regression_arm(train, val, names, arm, cfg, **params).select(
                F.lit(arm).alias("arm"), F.lit(k).alias("fold"), F.col("move").cast("int").alias("y"),
                F.col("movement").alias("p"), "target", "prediction"))
    pred = union_all(parts)
    scores = M.score_block(pred, ["arm", "fold"]).join(M.rmse(pred, "target", "prediction", ["arm", "fold"]), ["arm", "fold"])
    return scores.groupBy("arm").agg(F.avg("macro_f1").alias("move_f1"), F.stddev_pop("macro_f1").alias("move_f1_std"),
                                     F.avg("rmse").alias("rmse"))


def walk_forward_steps(rows: DataFrame) -> list[int]:
    """Every month that has development rows, some of them with a label, up to it and in the next one."""
    months = sorted(r[0] for r in development(rows).where(F.col("y").isNotNull()).select("month_idx").distinct().collect())
    return [m - 1 for m in months[1:]]


def walk_forward(rows: DataFrame, make: Maker, steps: Sequence[int]) -> DataFrame:
    """(test_month, scores): refit on months up to t, score month t + 1."""
    parts = []
    for t in steps:
        train, test = walk_forward_parts(rows, t)
        parts.append(predict(fit_balanced(make(), train), test).withColumn("test_month", F.lit(t + 1)))
    return M.score_block(union_all(parts), ["test_month"])


def decay_by_cutoff(at_cutoffs: DataFrame, make: Maker, cutoffs: Sequence[int], cfg: StudyConfig, seed: int = 42,
                    folds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(cutoff_days, macro_f1, macro_f1_std, balanced_acc) with the same users at every cutoff."""
    split = assign_run_split(at_cutoffs, seed, cfg)
    parts = [fold_predictions(split.where(F.col("cutoff_days") == c), make, folds=folds)
             .withColumn("cutoff_days", F.lit(c)) for c in cutoffs]
    return M.score_block(union_all(parts), ["cutoff_days", "fold"]).groupBy("cutoff_days").agg(
        F.avg("macro_f1").alias("macro_f1"), F.stddev_pop("macro_f1").alias("macro_f1_std"),
        F.avg("balanced_acc").alias("balanced_acc"))


def two_stage_decay(at_cutoffs: DataFrame, renew: Maker, move: Maker, cutoffs: Sequence[int], tau: float,
                    cfg: StudyConfig, seed: int = 42, folds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(cutoff_days, derived, stage-one and stage-two macro-F1) at a fixed threshold."""
    split = assign_run_split(at_cutoffs, seed, cfg)
    score = lambda train, test: two_stage_scores(train, test, renew, move)
    oof = union_all([out_of_fold(split.where(F.col("cutoff_days") == c), score, folds) for c in cutoffs])
    views = F.explode(F.array(
        F.struct(F.lit("derived").alias("part"), F.col("y"),
                 M.threshold_class(F.col("p_renew"), F.col("movement"), F.lit(tau)).alias("p")),
        F.struct(F.lit("stage1").alias("part"), F.col("renewed").cast("int").alias("y"),
                 (F.col("p_renew") >= 0.5).cast("int").alias("p")),
        F.struct(F.lit("stage2").alias("part"), F.col("move").cast("int").alias("y"), F.col("movement").alias("p"))))
    long = oof.select("cutoff_days", views.alias("v")).select("cutoff_days", "v.*").where(F.col("y").isNotNull())
    scored = M.score_block(long, ["cutoff_days", "part"])
    return scored.groupBy("cutoff_days").pivot("part", ["derived", "stage1", "stage2"]).agg(F.first("macro_f1"))


def single_feature_recovery(rows: DataFrame, one: Maker, full: Maker, cfg: StudyConfig, seeds: Sequence[int]) -> DataFrame:
    """(seed, single, full, recovered): share of the full model's macro-F1 kept by one feature."""
    scored = repeated_holdout(rows, {"single": one, "full": full}, cfg, seeds)
    wide = scored.groupBy("seed").pivot("model", ["single", "full"]).agg(F.first("macro_f1"))
    return wide.withColumn("recovered", F.col("single") / F.col("full"))


def class_mix_by_flag(rows: DataFrame, flag: str) -> DataFrame:
    """P(class | flag value) with the number of rows of each flag value."""
    from renewscope.operators.explore import crosstab_shares, row_totals

    mix = crosstab_shares(rows, flag, "label")
    return mix.join(row_totals(rows, flag, "label").select(flag, "label", "row_total"), [flag, "label"])
