"""Fits that advance together against single fits, Spark ML and plain refits."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from renewscope.config import StudyConfig
from renewscope.operators import fits as T
from renewscope.operators import metrics as M
from renewscope.operators import protocols as P
from renewscope.operators.features import fit_medians
from renewscope.plans import load_catalog
from renewscope.sources.stores import TrialLedger

# The SQL of a query module names tables of those before it, so that all are loaded in their order.
load_catalog()
from renewscope.plans import model_queries as Q  # noqa: E402

CFG = StudyConfig()
NAMES = ["pre_rate", "is_auto_renew", "gender", "city"]


@pytest.fixture(scope="module")
def rows(spark):
    """Overlapping classes, missing numbers, a rare level, a level of one month only, users with several rows."""
    n, noise = F.col("id"), lambda s: F.randn(s)
    y = F.pmod(F.xxhash64(n), F.lit(4)).cast("int")
    table = spark.range(1500, numPartitions=3).select(
        F.concat(F.lit("u"), (n / 3).cast("int")).alias("msno"), F.lit("2016-12-01").cast("date").alias("E"), (n % 6).cast("int").alias("month_idx"),
        F.when(n % 11 != 3, y * 0.7 + noise(1)).alias("pre_rate"), (y + noise(2) > 1).cast("double").alias("is_auto_renew"),
        F.when(n % 5 == 0, "x").when(n % 200 == 3, "rare").otherwise("y").alias("gender"), F.when(n % 6 == 5, "late").otherwise("c").alias("city"),
        y.cast("double").alias("y"), (y != 0).cast("double").alias("renew"), F.when(y != 0, y - 1).cast("double").alias("move"), (y != 0).cast("int").alias("renewed"),
        F.lit(100.0).alias("pre_secs"), (y * 60 + 30 * F.rand(5)).alias("post_total_secs"), (y * 0.6 + 0.3 * F.rand(5)).alias("vol_ratio"))
    fold = F.pmod(F.xxhash64("msno"), F.lit(6)).cast("int") - 1
    return table.withColumns({"user_fold": fold, "is_holdout": (fold < 0).cast("int")}).cache()


def many_fits():
    every = frozenset(range(5))
    folds = [T.Fit(f"{t}:{k}", t, c, "user_fold", every - {k}, frozenset({k}), c=s) for t, c in P.CLASSES.items() if c > 1 for k in range(3) for s in (1.0,)]
    return [*folds, T.Fit("loose", "y", 4, "user_fold", every, frozenset({-1}), c=100.0), T.Fit("one", "y", 4, "user_fold", every, names=("is_auto_renew",)),
            *[T.Fit(f"step:{t}", "y", 4, "month", frozenset(range(t + 1)), frozenset({t + 1})) for t in range(5)]]


@pytest.fixture(scope="module")
def prepared(rows):
    return P.prepare(rows, NAMES, P.month_splits())


def test_together_equals_alone(prepared):
    fits = many_fits()
    together = T.fit_together(prepared, fits, tol=1e-9)
    for f in fits[::5]:
        alone = T.fit_together(prepared, [f], tol=1e-9)
        assert np.abs(alone.coefficients[f.name] - together.coefficients[f.name]).max() < 1e-6
    # One pass an iteration for all, not for each.
    assert together.passes < 2 + 2 * max(together.iterations.values()) < sum(together.iterations.values())


def test_coefficients_equal_spark_ml(rows, prepared):
    f = T.Fit("full", "y", 4, "user_fold", frozenset(range(5)), c=0.5)
    got = T.fit_together(prepared, [f], tol=1e-9)
    dev = rows.where("is_holdout = 0")
    median = fit_medians(dev, ["pre_rate"]).first()["median"]
    x = dev.withColumn("pre_rate", F.coalesce("pre_rate", F.lit(median)))
    m = x.agg(*[g(c) for c in ("pre_rate", "is_auto_renew") for g in (F.avg, F.stddev_pop)]).first()
    held = dict(dev.groupBy("gender").count().collect())
    assert held["rare"] < 50 <= min(held["x"], held["y"])
    cols = [(F.col("pre_rate") - m[0]) / m[1], (F.col("is_auto_renew") - m[2]) / m[3], *[(F.col("gender") == v).cast("double") for v in ("x", "y", "rare")],
            *[(F.col("city") == v).cast("double") for v in ("c", "late")]]
    n = x.count()
    weights = {r["y"]: n / (4 * r["count"]) for r in x.groupBy("y").count().collect()}
    w = F.element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("y"))
    ml = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", family="multinomial", regParam=1 / (0.5 * n), standardization=False, maxIter=500, tol=1e-12)
    want = ml.fit(x.select(array_to_vector(F.array(*cols)).alias("v"), "y", w.alias("w"))).coefficientMatrix.toArray()
    own = got.maps["full"]
    mine = np.linalg.lstsq(own, got.coefficients["full"], rcond=None)[0][1:]
    # The design's order: numbers, then levels in text order (city before gender, as the contract lists them), rare ones last.
    order = sorted(range(mine.shape[0]), key=lambda i: tuple(np.round(mine[i], 6)))
    other = sorted(range(want.shape[1]), key=lambda i: tuple(np.round(want[:, i], 6)))
    assert np.abs(mine[order] - want.T[other]).max() < 1e-4


def test_medians_are_exact(rows, prepared):
    fits = many_fits()
    got = T.pool_medians(prepared, fits)
    for f in fits:
        part = rows.withColumns(P.month_splits()).where(F.col(f.split).isin(*f.train) & F.col(f.target).isNotNull())
        want = {r["column"]: r["median"] for r in fit_medians(part, prepared.nums).collect()}
        assert np.allclose(got[f.name] * prepared.scale + prepared.center, [want[c] for c in prepared.nums])


def test_medians_are_counted_by_leading_bits(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.uniform(1, 2, 3000), -rng.lognormal(2, 3, 1999), [0.0, -0.0, 1e300, -1e-300]])
    bits = T._ordered_bits(np.sort(values))
    assert (np.diff(bits.astype(float)) >= 0).all()
    table = spark.createDataFrame([([float(v), None if i % 3 else float(i % 7)], i % 5, float(i % 2)) for i, v in enumerate(values)], "x array<double>, fold int, y double")
    d = T.Design(table, ["a", "b"], [], {}, np.zeros(2), np.ones(2))
    fits = [T.Fit(f"{c}:{k}", "y", 2, "fold", frozenset(range(5)) - {k}, c=c) for c in (0.1, 1.0) for k in range(5)]
    got = T.pool_medians(d, fits)
    for f in fits:
        mine = np.arange(len(values)) % 5 != int(f.name[-1])
        sparse = np.arange(len(values))[mine & (np.arange(len(values)) % 3 == 0)] % 7
        np.testing.assert_allclose(got[f.name], [np.median(values[mine]), np.median(sparse)], rtol=1e-14)
    # What a task hands on doesn't grow with its rows: 64 counts a doubling of the values.
    told = table.where("x[0] >= 1 AND x[0] < 2").select("x", "fold", "y").coalesce(1).mapInArrow(
        T._cell_counts(2, [("fold|y", "fold", "y")], None), "pool string, cell long, number int, at long, n long").where("number = 0")
    assert told.count() <= 5 * 64 and told.agg(F.sum("n")).first()[0] == 3000


def test_rows_are_scored_once_under_their_own_fold(rows, prepared):
    fits = [f for f in many_fits() if f.name.startswith("y:")]
    fitted = T.fit_together(prepared, fits)
    scored = T.score_routed(prepared, fitted, ["msno", "month_idx", "user_fold"])
    assert scored._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan") == 1
    apart = [T.score_routed(prepared, T.fit_together(prepared, [f]), ["msno", "month_idx", "user_fold"]) for f in fits]
    keys = lambda df: {(r["msno"], r["month_idx"], r["fit"]): np.round(r["probs"], 5).tolist() for r in df.collect()}
    together = keys(scored)
    assert together == {k: v for part in apart for k, v in keys(part).items()}
    assert scored.where("concat('y:', user_fold) != fit").count() == 0 and len(together) == rows.where("user_fold IN (0, 1, 2)").count()


def test_walk_forward_equals_plain_refits(rows):
    got = {(r["protocol"], r["test_month"]): r["macro_f1"] for r in P.walk_forward(rows, NAMES, CFG, [0, 2, 4], tau=0.5).collect()}
    ways = {"direct", "two_stage", "regression_volume", "regression_ratio"}
    assert set(got) == {(p, t) for p in ways for t in (1, 3, 5)}
    for t in (0, 4):
        part = P.with_arms(rows).where(F.col("is_holdout") == 0).withColumn("role", F.when(F.col("month_idx") <= t, 0).when(F.col("month_idx") == t + 1, 1))
        d = P.prepare(part, NAMES)
        fits = [T.Fit(f"a|{k}_p", k, c, "role", frozenset({0}), frozenset({1})) for k, c in P.CLASSES.items()]
        scored = P._staged(P._run(d, fits, ["y", "pre_secs"]))
        told = scored.select("y", P._all_ways(scored, CFG, lambda p: F.lit(0.5)).alias("v")).select("y", "v.*")
        want = {r["protocol"]: r["macro_f1"] for r in M.score_block(told, ["protocol"]).collect()}
        assert {p: got[p, t + 1] for p in ways} == pytest.approx(want, abs=0.01)
    assert P.walk_forward(rows, NAMES, CFG, []).count() == 0


def test_least_squares_equal_plain_ones(rows):
    d = P.prepare(P.with_arms(rows), NAMES)
    f = T.Fit("arm", "t_ratio", 1, "user_fold", frozenset({0, 1, 2}), frozenset({3}), c=2.0)
    got = T.solve_together(d, [f])
    data = [r for r in d.rows.select("x", "lv", "t_ratio", "user_fold").collect() if r["user_fold"] in f.train and r["t_ratio"] is not None]
    basis = np.zeros((len(data), d.width))
    for row, r in zip(basis, data):
        row[0] = 1
        for j, v in enumerate(r["x"]):
            row[1 + j], row[1 + len(d.nums) + j] = (0, 1) if v is None else (v, 0)
        for c, level in zip(d.cats, r["lv"]):
            row[d.level_at(c) + level] = level >= 0
    own = basis @ got.maps["arm"]
    assert np.abs(own[:, 1 : 1 + len(d.nums)].mean(0)).max() < 1e-9 and np.allclose(own[:, 1 : 1 + len(d.nums)].std(0), 1)
    penalty = np.sqrt(0.5) * np.eye(own.shape[1])[1:]
    want = np.linalg.lstsq(np.vstack([own, penalty]), np.append([r["t_ratio"] for r in data], np.zeros(len(penalty))), rcond=None)[0]
    assert np.allclose(basis @ got.coefficients["arm"][:, 0], own @ want, atol=1e-8)
    assert P.prepare(P.with_arms(rows), NAMES).rows.where("t_ratio IS NOT NULL AND renewed = 0").count() == 0


def test_nested_runs(rows):
    got = {(r["seed"], r["protocol"]): r for r in P.nested_runs(rows, NAMES, CFG, [42, 43], [0.01, 1.0], folds=(0, 1)).collect()}
    assert set(got) == {(s, p) for s in ("42", "43") for p in ("direct", "two_stage", "regression_volume", "regression_ratio")}
    assert all((r["tau"] is None) == (p == "direct") and r["c_first"] in (0.01, 1.0) and r["macro_f1"] > 0.3 for (_, p), r in got.items())


def test_nested_query_tunes_on_every_fold(rows, monkeypatch):
    """All of a stage's trials score each development row once: no fold is left out of the choice of a strength."""
    seen, run = [], P._run
    monkeypatch.setattr(Q, "_rows", lambda inp: (rows, NAMES))
    monkeypatch.setattr(Q, "RUN_SEEDS", (42,))
    monkeypatch.setattr(Q, "STRENGTHS", (0.01, 1.0))
    monkeypatch.setattr(P, "_run", lambda d, fits, carried: seen.append(fits) or run(d, [replace(f, max_iter=5) for f in fits], carried))
    assert Q.nested_protocol_runs(type("I", (), {"cfg": CFG})).count() == 4
    for stage in P.STAGES:
        for trial in (0, 1):
            assert sorted(k for f in seen[0] if f.name.startswith(f"42:{stage}:{trial}:") for k in f.score) == list(range(CFG.n_folds))


def test_two_stage_runs_and_tuned_holdouts(rows):
    got = P.two_stage_runs(rows, NAMES, CFG, [42, 43], folds=(0, 1)).collect()
    assert {(r["seed"], r["model"]) for r in got} == {(s, m) for s in ("42", "43") for m in ("argmax", "tuned")}
    runs = P.repeated_holdout(rows, NAMES, CFG, [42, 43], [0.001, 1.0], folds=(0, 1)).collect()
    assert len(runs) == 2 and all(r["c"] in (0.001, 1.0) and r["macro_f1"] > 0.3 for r in runs)


def test_fits_that_score_their_training_cells_fail(rows, prepared):
    with pytest.raises(ValueError, match="bad"):
        P._run(prepared, [T.Fit("bad", "y", 4, "user_fold", frozenset({0, 1}), frozenset({1}))], ["y"])
    with pytest.raises(ValueError, match="different names"):
        T.fit_together(prepared, [many_fits()[0]] * 2)


def test_decay_over_cutoffs(rows):
    at = rows.withColumn("cutoff_days", F.explode(F.array(F.lit(0), F.lit(7)))).withColumn("pre_rate", F.when(F.col("cutoff_days") == 0, F.col("pre_rate")).otherwise(F.col("pre_rate") + F.randn(7)))
    got = P.decay_by_fold(at, NAMES, (0, 7), CFG, folds=(0, 1)).collect()
    start = {r["fold"]: r["macro_f1"] for r in got if r["cutoff_days"] == "0"}
    assert len(got) == 4 and all(r["difference"] == pytest.approx(r["macro_f1"] - start[r["fold"]]) for r in got)
    assert P.two_stage_decay(at, NAMES, (0, 7), 0.5, CFG, folds=(0,)).count() == 2


def decayed(rows, monkeypatch, query):
    """Rows of a decay query over two cutoffs, and the cells that its fits score."""
    at = rows.withColumn("cutoff_days", F.explode(F.array(F.lit(0), F.lit(7))))
    seen, fits = [], P._cutoff_fits
    monkeypatch.setattr(Q, "_cutoff_rows", lambda inp: (at, NAMES))
    monkeypatch.setattr(P, "_cutoff_fits", lambda *a: [seen.append(f) or replace(f, max_iter=5) for f in fits(*a)])
    got = getattr(Q, query)(type("I", (), {"cfg": CFG.with_(cutoffs=(0, 7))})).collect()
    return got, sorted(k for f in seen for k in f.score)


def test_decay_by_cutoff_scores_every_fold(rows, monkeypatch):
    got, cells = decayed(rows, monkeypatch, "accuracy_decay_by_cutoff")
    assert cells == list(range(2 * CFG.n_folds)) and {r["cutoff_days"] for r in got} == {"0", "7"}


def test_decay_by_fold_has_every_fold(rows, monkeypatch):
    got, cells = decayed(rows, monkeypatch, "accuracy_decay_by_fold")
    assert cells == list(range(2 * CFG.n_folds)) and {(r["cutoff_days"], int(r["fold"])) for r in got} == {(c, k) for c in ("0", "7") for k in range(CFG.n_folds)}


def test_search_learns_from_all_rows(rows, monkeypatch):
    """Over more rows than the published subsample has, the search is handed every one."""
    seen = []
    monkeypatch.setattr(Q, "_rows", lambda inp: (rows, NAMES))
    monkeypatch.setattr(Q, "SUBSAMPLE", 400)
    monkeypatch.setattr(P, "random_search", lambda d, *a: seen.append(d.rows.count()))
    Q.hyper_parameter_search(type("I", (), {"cfg": CFG}))
    assert seen == [rows.count()]


def test_comparison_learns_from_all_rows(rows, monkeypatch):
    """Over more rows than the published subsample has, every family of models is handed all of them."""
    seen, scores = {}, rows.sparkSession.createDataFrame([], "model string")
    monkeypatch.setattr(Q, "_rows", lambda inp: (rows, NAMES))
    monkeypatch.setattr(Q, "SUBSAMPLE", 400)
    monkeypatch.setattr(P, "cross_validated", lambda d, *a: seen.update(logistic=d.rows.count()) or scores)
    monkeypatch.setattr(P, "boosted_cv", lambda r, *a, **k: (seen.update(boosted=r.count()) or scores, {}))
    monkeypatch.setattr(Q.L, "cross_validate", lambda r, *a, **k: seen.update(forest=r.count()) or scores)
    Q.model_comparison(type("I", (), {"cfg": CFG}))
    assert seen == dict.fromkeys(("logistic", "boosted", "forest"), rows.count())


def test_search_resumes_behind_the_last_committed_trial(spark, prepared, tmp_path, monkeypatch):
    grid, fitted = {"c": [0.01, 0.1, 1.0, 10.0]}, []
    real, ledger = P.cross_validated, TrialLedger(spark, str(tmp_path), "search")

    def counted(d, cfg, models, folds):
        fitted.extend(models)
        return real(d, cfg, models, folds)

    monkeypatch.setattr(P, "cross_validated", counted)
    commit = TrialLedger.commit

    def lost(self, trial, record):
        if trial == 3:
            raise RuntimeError("driver lost")
        commit(self, trial, record)

    monkeypatch.setattr(TrialLedger, "commit", lost)
    with pytest.raises(RuntimeError):
        P.random_search(prepared, CFG, grid, 6, 42, ledger, folds=(0,), at_once=2)
    monkeypatch.setattr(TrialLedger, "commit", commit)
    assert ledger.missing(6) == [3, 4, 5]
    fitted.clear()
    trials = P.random_search(prepared, CFG, grid, 6, 42, ledger, folds=(0,), at_once=2)
    assert fitted == ["0003", "0004", "0005"] and trials.count() == 6
    whole = P.random_search(prepared, CFG, grid, 6, 42, TrialLedger(spark, str(tmp_path), "whole"), folds=(0,), at_once=6)
    assert P.best_trial(trials, ["c"]) == P.best_trial(whole, ["c"])
