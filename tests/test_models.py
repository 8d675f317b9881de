"""Evaluation protocols on a small separable table."""

import pytest
from pyspark.sql import functions as F

from renewscope.config import MODEL_CLASSES, MOVEMENT_CLASSES, StudyConfig
from renewscope.functions.scalar import code_of
from renewscope.operators import models as L
from renewscope.operators.splits import with_fixed_split
from renewscope.sources.stores import SweepStore

CFG = StudyConfig()
NAMES = ["pre_rate", "is_auto_renew", "gender"]


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    label = F.when(n % 4 == 0, "CHURN").when(n % 4 == 1, "CONTRACTION").when(n % 4 == 2, "STABLE").otherwise("EXPANSION")
    ratio = F.when(n % 4 == 1, 0.2).when(n % 4 == 2, 1.0).otherwise(2.5)
    raw = spark.range(600).select(
        F.concat(F.lit("u"), (n / 2).cast("int")).alias("msno"), F.lit("2016-12-01").cast("date").alias("E"),
        F.lit("2016-12").alias("expiry_month"), label.alias("label"), (n % 4 != 0).cast("int").alias("renewed"),
        ratio.alias("vol_ratio"), (ratio * 100).alias("post_total_secs"), F.lit(100.0).alias("pre_secs"),
        F.when(n % 50 != 7, (n % 4).cast("double") + F.rand(3) / 10).alias("pre_rate"),
        (n % 4 > 0).cast("double").alias("is_auto_renew"), F.when(n % 3 == 0, "x").otherwise("y").alias("gender"))
    table = with_fixed_split(raw, CFG)
    return table.withColumns({
        "y": code_of(F.col("label"), MODEL_CLASSES).cast("double"), "renew": F.col("renewed").cast("double"),
        "move": code_of(F.col("label"), MOVEMENT_CLASSES).cast("double")}).cache()


def test_cross_validation_and_search(rows, spark, tmp_path):
    makers = {"logit": lambda: L.logistic(NAMES, max_iter=20), "trees": lambda: L.forest(NAMES, trees=4, leaf=1, depth=4)}
    got = {r["model"]: r for r in L.cross_validate(rows, makers, folds=(0, 1)).collect()}
    assert all(r["macro_f1"] > 0.9 for r in got.values())
    store = SweepStore(spark, str(tmp_path))
    make = lambda max_iter: L.logistic(NAMES, max_iter=max_iter)
    best, trials = L.random_search(rows, make, {"max_iter": [1, 20]}, 2, 7, folds=(0,), store=store)
    assert trials.count() == 2 and best == L.random_search(rows, None, {}, 0, 0, store=store)[0]
    assert L.draw_configs({"a": [1, 2, 3]}, 4, 5) == L.draw_configs({"a": [1, 2, 3]}, 4, 5)


def test_two_stage(rows):
    runs = L.two_stage_runs(rows, lambda: L.logistic(NAMES, "renew", 20), lambda: L.logistic(NAMES, "move", 20), CFG, [42], folds=(0,))
    got = {r["model"]: r for r in runs.collect()}
    assert set(got) == {"argmax", "tuned"} and got["tuned"]["macro_f1"] > 0.9
    quality = L.stage_one_quality(rows, lambda: L.logistic(NAMES, "renew", 20)).first()
    assert quality["roc_auc"] > 0.99


def test_regression_arms(rows):
    got = {r["arm"]: r for r in L.regression_cv(rows, NAMES, CFG, folds=(0,), rounds=3, depth=3, step=0.5).collect()}
    assert got["volume"]["move_f1"] > 0.9 and got["ratio"]["move_f1"] > 0.9 and got["ratio"]["rmse"] < 0.5


def test_queries_fit_the_published_sizes(spark, monkeypatch):
    from renewscope.operators.fits import Fit
    from renewscope.plans import model_queries as Q

    fit = Fit("one", "y", 4, "user_fold", frozenset({0}))
    assert (fit.max_iter, fit.c) == (300, 1.0) and Q.SUBSAMPLE == 200_000 and Q.TRIALS == 16
    forest = Q._forest(NAMES)().getStages()[-1]
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (200, 12)
    given = {}
    monkeypatch.setattr(Q, "_rows", lambda inp: (None, NAMES))
    monkeypatch.setattr(Q.P, "boosted_arms", lambda *a, **b: given.update(b, folds=a[3]))
    getattr(Q.regression_arms, "__wrapped__", Q.regression_arms)(type("I", (), {"cfg": CFG}))
    assert given == {"rounds": 400, "depth": 6, "step": 0.05, "folds": (0, 1, 2)}
    assert Q.CLASS_TREES == {"rounds": 300, "depth": 5, "step": 0.1}
