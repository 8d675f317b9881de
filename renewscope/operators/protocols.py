"""Evaluation protocols whose models are fitted together and whose rows are scored once.

Folds, seeds, steps, trials and cutoffs are cells of a split column (see fits.py). A protocol names its fits, lets
all of them advance in shared passes, and scores every row under the fits of its own cell in one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewscope.config import StudyConfig
from renewscope.functions.scalar import argmax_index
from renewscope.operators import metrics as M
from renewscope.operators.features import categorical_columns, numeric_columns
from renewscope.operators.boosting import Binned, Boost, Forest, binned, boost_together, boosted_scores, gain_table
from renewscope.operators.fits import Design, Fit, Fitted, design, fit_together, score_routed, solve_together
from renewscope.operators.models import draw_configs, regression_target
from renewscope.operators.splits import run_columns
from renewscope.sources.stores import TrialLedger

HELD = -1
#: Classes of each target; the regressed ones have none.
CLASSES = {"y": 4, "renew": 2, "move": 3, "t_volume": 1, "t_ratio": 1}
ARMS = ("volume", "ratio")


def with_arms(rows: DataFrame) -> DataFrame:
    """`t_volume` and `t_ratio`: what the regression arms predict, for renewers."""
    return rows.withColumns({f"t_{a}": F.when(F.col("renewed") == 1, regression_target(a)) for a in ARMS})


def prepare(rows: DataFrame, names: Sequence[str], splits: dict[str, Column] | None = None) -> Design:
    """Rows with the split columns of a protocol, ready for its fits."""
    return design(rows.withColumns(splits or {}), numeric_columns(names), categorical_columns(names))


def seed_splits(seeds: Sequence[int], cfg: StudyConfig) -> dict[str, Column]:
    """`run_<seed>`: the user's fold in each run, HELD for its holdout."""
    return {f"run_{s}": run_columns(F.lit(str(s)), cfg)["user_fold"] for s in seeds}


def fold_fits(name: str, target: str, split: str, cfg: StudyConfig, folds: Sequence[int], slot: str = "", **params) -> list[Fit]:
    """One fit a fold, learned from all other folds and scoring its own: `name:fold`."""
    every = frozenset(range(cfg.n_folds))
    return [Fit(f"{name}:{k}" + (f"|{slot}" if slot else ""), target, CLASSES[target], split, every - {k}, frozenset({k}), **params) for k in folds]


def refit(name: str, target: str, split: str, cfg: StudyConfig, slot: str = "", **params) -> Fit:
    """A fit on all development users that scores the holdout: `name:all`."""
    return Fit(f"{name}:all" + (f"|{slot}" if slot else ""), target, CLASSES[target], split, frozenset(range(cfg.n_folds)), frozenset({HELD}), **params)


def assert_no_leak(fits: Sequence[Fit]) -> None:
    """No fit scores a cell that it learned from."""
    leaks = [f.name for f in fits if f.train & f.score]
    if leaks:
        raise ValueError(f"fits that score their own training cells: {leaks}")


def _run(d: Design, fits: Sequence[Fit], carried: Sequence[str]) -> DataFrame:
    """Rows scored under all fits: classifiers advance together, regressions are solved together."""
    assert_no_leak(fits)
    coefficients = {}
    for solve, part in ((fit_together, [f for f in fits if f.classes > 1]), (solve_together, [f for f in fits if f.classes == 1])):
        if part:
            coefficients |= solve(d, part).coefficients
    return score_routed(d, Fitted(list(fits), coefficients, {}), carried)


def _named(scored: DataFrame, *names: str) -> DataFrame:
    """The parts of `a:b:…:part` in columns of their own."""
    parts = F.split("fit", ":")
    return scored.withColumns({n: F.get(parts, i) for i, n in enumerate(names)})


def _predicted(scored: DataFrame, target: str = "y") -> DataFrame:
    return scored.where(F.col(target).isNotNull()).withColumns({"y": F.col(target).cast("int"), "p": argmax_index(F.col("probs"))})


def fold_means(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean and population spread over folds of each group's scores."""
    return scored.groupBy(*groups).agg(F.avg("macro_f1").alias("macro_f1"), F.stddev_pop("macro_f1").alias("macro_f1_std"),
                                       F.avg("balanced_acc").alias("balanced_acc"))


def cross_validated(d: Design, cfg: StudyConfig, models: dict[str, dict], folds: Sequence[int] = (0, 1, 2), target: str = "y") -> DataFrame:
    """(model, scores over folds) of logistic models given by their parameters, all fitted together."""
    fits = [f for name, params in models.items() for f in fold_fits(name, target, "user_fold", cfg, folds, **params)]
    scored = _named(_predicted(_run(d, fits, [target]), target), "model", "fold")
    return fold_means(M.score_block(scored, ["model", "fold"]), ["model"])


def repeated_holdout(rows: DataFrame, names: Sequence[str], cfg: StudyConfig, seeds: Sequence[int], strengths: Sequence[float],
                     folds: Sequence[int] = (0, 1, 2), features: dict[str, Sequence[str] | None] | None = None) -> DataFrame:
    """(seed, model, c, scores): split, tune, refit and score, each run's strength chosen on its own development users.

    The inner folds are cells of the run's own split, so they hold development users only, and no fit may
    score a cell that it learned from. All trials of all runs are fitted together, then all refits."""
    features = features or {"logistic": None}
    d = prepare(rows, names, seed_splits(seeds, cfg))
    own = {m: tuple(v) if v is not None else None for m, v in features.items()}
    trials = [f for s in seeds for m in features for i, c in enumerate(strengths) if len(strengths) > 1
              for f in fold_fits(f"{s}:{m}:{i}", "y", f"run_{s}", cfg, folds, c=c, names=own[m])]
    chosen = {}
    if trials:
        scored = _named(_predicted(_run(d, trials, ["y"])), "seed", "model", "trial", "fold")
        table = fold_means(M.score_block(scored, ["seed", "model", "trial", "fold"]), ["seed", "model", "trial"])
        # Seeds x models x trials rows; ties go to the first trial.
        for r in sorted(table.collect(), key=lambda r: (-r["macro_f1"], int(r["trial"]))):
            chosen.setdefault((int(r["seed"]), r["model"]), strengths[int(r["trial"])])
    fits = [refit(f"{s}:{m}", "y", f"run_{s}", cfg, c=chosen.get((s, m), strengths[0]), names=own[m]) for s in seeds for m in features]
    scored = _named(_predicted(_run(d, fits, ["y"])), "seed", "model")
    picked = rows.sparkSession.createDataFrame([(str(s), m, float(chosen.get((s, m), strengths[0]))) for s in seeds for m in features], "seed string, model string, c double")
    return M.score_block(scored, ["seed", "model"]).join(F.broadcast(picked), ["seed", "model"])


def _two_stages(name: str, split: str, cfg: StudyConfig, folds: Sequence[int], whole: bool) -> list[Fit]:
    """Renewal and movement of each fold and, if wanted, of all development users."""
    fits = [f for t in ("renew", "move") for f in fold_fits(name, t, split, cfg, folds, slot=t)]
    return fits + ([refit(name, t, split, cfg, slot=t) for t in ("renew", "move")] if whole else [])


def _staged(scored: DataFrame) -> DataFrame:
    """Truth, probability of renewal, movement and composed class of rows scored by both stages."""
    return scored.withColumns({"y": F.col("y").cast("int"), "p_renew": F.get("renew_p", F.lit(1)), "q": F.col("move_p")}).withColumns(
        {"movement": argmax_index(F.col("q")), "composed": argmax_index(M.compose_probabilities(F.col("p_renew"), F.col("q")))})


def _both(d: Design, fits: Sequence[Fit], carried: Sequence[str]) -> DataFrame:
    """Scores of both stages side by side; the slots are renamed, as rows have targets of the same names."""
    slotted = [Fit(**{**f.__dict__, "name": f"{f.name}_p"}) for f in fits]
    return _run(d, slotted, carried)


def two_stage_runs(rows: DataFrame, names: Sequence[str], cfg: StudyConfig, seeds: Sequence[int], folds: Sequence[int] | None = None) -> DataFrame:
    """(seed, model, best_tau, scores) of the arg-max and the tuned two-stage classifier.

    Folds and refits of all seeds are fitted together; one scan scores development rows under their own fold's
    models, from which each run's threshold is learned, and holdout rows under the refits."""
    folds = range(cfg.n_folds) if folds is None else folds
    d = prepare(rows, names, seed_splits(seeds, cfg))
    fits = [f for s in seeds for f in _two_stages(str(s), f"run_{s}", cfg, folds, whole=True)]
    scored = _named(_staged(_both(d, fits, ["y"])), "seed", "fold").drop("renew_p", "move_p")
    held = scored.where(F.col("fold") == "all")
    taus = M.best_tau(scored.where(F.col("fold") != "all"), groups=["seed"]).select("seed", F.col("tau").alias("best_tau"))
    both = F.explode(F.array(
        F.struct(F.lit("argmax").alias("model"), F.col("composed").alias("p")),
        F.struct(F.lit("tuned").alias("model"), M.threshold_class(F.col("p_renew"), F.col("movement"), F.col("best_tau")).alias("p"))))
    # One threshold a run.
    told = held.join(F.broadcast(taus), "seed").select("seed", "best_tau", "y", both.alias("m"))
    return M.score_block(told.select("seed", "best_tau", "y", "m.model", "m.p"), ["seed", "model", "best_tau"])


def stage_one_quality(rows: DataFrame, names: Sequence[str], cfg: StudyConfig) -> DataFrame:
    """Ranking scores and macro-F1 at 0.5 of the renewal stage on held-out users."""
    d = prepare(rows, names)
    scored = _run(d, [refit("stage", "renew", "user_fold", cfg)], ["renewed"]).select(
        F.col("renewed").cast("int").alias("y"), F.get("probs", F.lit(1)).alias("score"))
    block = M.score_block(scored.withColumn("p", (F.col("score") >= 0.5).cast("int")))
    return M.ranking_scores(scored, "score", "y").select("*", block.select("macro_f1").scalar().alias("macro_f1"))


def month_splits() -> dict[str, Column]:
    """`month`: the expiry month's number for development users, HELD for others."""
    return {"month": F.when(F.col("is_holdout") == 0, F.col("month_idx")).otherwise(HELD)}


def _arm_class(arm: str, cfg: StudyConfig, tau) -> Column:
    """Class by a regression arm: the renewal stage's threshold, then the movement that the predicted ratio means."""
    ratio = M.ratio_from_prediction(F.get(f"t_{arm}_p", F.lit(0)), F.col("pre_secs"), arm)
    return M.threshold_class(F.col("p_renew"), M.ratio_to_movement(ratio, cfg), tau)


def _arm_taus(scored: DataFrame, cfg: StudyConfig, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, protocol, tau): the best threshold of the two-stage classifier and of each arm on the rows given."""
    ways = {"two_stage": F.col("movement")} | {f"regression_{a}": M.ratio_to_movement(M.ratio_from_prediction(F.get(f"t_{a}_p", F.lit(0)), F.col("pre_secs"), a), cfg) for a in ARMS}
    views = F.explode(F.array(*[F.struct(F.lit(n).alias("protocol"), m.alias("movement")) for n, m in ways.items()]))
    long = scored.select(*groups, "y", "p_renew", views.alias("v")).select(*groups, "y", "p_renew", "v.*")
    return M.best_tau(long, groups=[*groups, "protocol"]).drop("macro_f1")


def _all_ways(scored: DataFrame, cfg: StudyConfig, tau) -> Column:
    """(protocol, p) of the direct and the two-stage classifier and of both regression arms; `tau` gives a protocol's threshold."""
    return F.explode(F.array(
        F.struct(F.lit("direct").alias("protocol"), argmax_index(F.col("y_p")).alias("p")),
        F.struct(F.lit("two_stage").alias("protocol"), M.threshold_class(F.col("p_renew"), F.col("movement"), tau("two_stage")).alias("p")),
        *[F.struct(F.lit(f"regression_{a}").alias("protocol"), _arm_class(a, cfg, tau(f"regression_{a}")).alias("p")) for a in ARMS]))


STAGES = ("y", "renew", "move", "t_volume", "t_ratio")


def walk_forward(rows: DataFrame, names: Sequence[str], cfg: StudyConfig, steps: Sequence[int], tau: float | None = None) -> DataFrame:
    """(protocol, test_month, scores) of the direct classifier, the two-stage one and both regression arms: learn from
    months up to t, score month t + 1.

    A month's statistics are collected once and merged in the order of time; in each pass a row serves all steps
    that learn from its month. Thresholds, unless one is given, are learned from out-of-fold scores of all
    development users, as published, fitted in the same passes."""
    if not steps:
        return rows.sparkSession.createDataFrame([], "protocol string, test_month int, accuracy double, balanced_acc double, macro_f1 double, weighted_f1 double, n long")
    d = prepare(with_arms(rows), names, month_splits())
    low = rows.agg(F.min(F.when(F.col("is_holdout") == 0, F.col("month_idx")))).first()[0]
    fits = [Fit(f"step:{t}|{s}_p", s, CLASSES[s], "month", frozenset(range(low, t + 1)), frozenset({t + 1})) for t in steps for s in STAGES]
    inner = [] if tau is not None else [f for s in STAGES[1:] for f in fold_fits("tau", s, "user_fold", cfg, range(cfg.n_folds), slot=f"{s}_p")]
    scored = _named(_staged(_run(d, [*fits, *inner], ["y", "pre_secs"])), "kind", "part")
    taus = {} if tau is not None else {r["protocol"]: r["tau"] for r in _arm_taus(scored.where(F.col("kind") == "tau"), cfg).collect()}
    stepped = scored.where(F.col("kind") == "step").withColumn("test_month", F.col("part").cast("int") + 1)
    ways = _all_ways(stepped, cfg, lambda p: F.lit(taus.get(p, 0.5 if tau is None else tau)))
    return M.score_block(stepped.select("test_month", "y", ways.alias("v")).select("test_month", "y", "v.*"), ["protocol", "test_month"])


def nested_runs(rows: DataFrame, names: Sequence[str], cfg: StudyConfig, seeds: Sequence[int], strengths: Sequence[float],
                folds: Sequence[int] | None = None) -> DataFrame:
    """(seed, protocol, strengths, tau, scores): split, tune, refit and score for the direct classifier, the two-stage one
    and both regression arms, each run by itself.

    Every stage's strength is tuned on the run's development users by the run's own folds, all of them unless `folds` names some, classifiers by macro-F1 and arms by the
    root mean squared error; thresholds come from out-of-fold scores of the tuned stages. Everything of all
    seeds is fitted together, trials first, then folds and refits."""
    folds = range(cfg.n_folds) if folds is None else folds
    d = prepare(with_arms(rows), names, seed_splits(seeds, cfg))
    trials = [f for s in seeds for t in STAGES for i, c in enumerate(strengths) for f in fold_fits(f"{s}:{t}:{i}", t, f"run_{s}", cfg, folds, c=c)]
    told = _named(_run(d, trials, STAGES), "seed", "stage", "trial", "fold")
    truth = F.coalesce(*[F.when(F.col("stage") == t, F.col(t)) for t in STAGES])
    told = told.withColumn("truth", truth).where(F.col("truth").isNotNull())
    classified = told.where(~F.col("stage").startswith("t_")).withColumns({"y": F.col("truth").cast("int"), "p": argmax_index(F.col("probs"))})
    keys = ["seed", "stage", "trial", "fold"]
    block = M.score_block(classified, keys).select(*keys, F.col("macro_f1").alias("score"))
    arms = M.rmse(told.where(F.col("stage").startswith("t_")).withColumn("value", F.get("probs", F.lit(0))), "truth", "value", keys)
    table = block.unionByName(arms.select(*keys, (-F.col("rmse")).alias("score"))).groupBy("seed", "stage", "trial").agg(F.avg("score").alias("score"))
    chosen: dict = {}
    # Seeds x stages x trials rows; ties go to the first trial.
    for r in sorted(table.collect(), key=lambda r: (-r["score"], int(r["trial"]))):
        chosen.setdefault((int(r["seed"]), r["stage"]), float(strengths[int(r["trial"])]))
    fits = [refit(str(s), t, f"run_{s}", cfg, slot=f"{t}_p", c=chosen[s, t]) for s in seeds for t in STAGES]
    fits += [f for s in seeds for t in STAGES[1:] for f in fold_fits(str(s), t, f"run_{s}", cfg, range(cfg.n_folds), slot=f"{t}_p", c=chosen[s, t])]
    scored = _named(_staged(_run(d, fits, ["y", "pre_secs"])), "seed", "fold")
    taus = _arm_taus(scored.where(F.col("fold") != "all"), cfg, ["seed"]).groupBy("seed").agg(F.map_from_entries(F.collect_list(F.struct("protocol", "tau"))).alias("taus"))
    held = scored.where(F.col("fold") == "all").join(F.broadcast(taus), "seed")
    ways = _all_ways(held, cfg, lambda p: F.col("taus")[p])
    long = held.select("seed", "taus", "y", ways.alias("v")).select("seed", F.try_element_at("taus", F.col("v.protocol")).alias("tau"), "y", "v.*")
    parts = {"direct": ("y",), "two_stage": ("renew", "move"), "regression_volume": ("renew", "t_volume"), "regression_ratio": ("renew", "t_ratio")}
    picked = rows.sparkSession.createDataFrame([(str(s), p, *[chosen[s, t] for t in (ts + ts)[:2]]) for s in seeds for p, ts in parts.items()], "seed string, protocol string, c_first double, c_second double")
    return M.score_block(long, ["seed", "protocol", "tau"]).join(F.broadcast(picked), ["seed", "protocol"])


def cutoff_splits(cutoffs: Sequence[int], seed: int, cfg: StudyConfig) -> dict[str, Column]:
    """`at`: the cutoff's number times ten folds and the user's fold of one run, so that a user has the same fold at all cutoffs."""
    fold = run_columns(F.lit(str(seed)), cfg)["user_fold"]
    number = F.array_position(F.array(*[F.lit(int(c)) for c in cutoffs]), F.col("cutoff_days").cast("int")).cast("int") - 1
    return {"at": F.when((fold >= 0) & (number >= 0), number * cfg.n_folds + fold).otherwise(HELD)}


def _cutoff_fits(cutoffs: Sequence[int], cfg: StudyConfig, folds: Sequence[int], targets: dict[str, str]) -> list[Fit]:
    cells = lambda i, part: frozenset(i * cfg.n_folds + k for k in part)
    every = range(cfg.n_folds)
    return [Fit(f"{c}:{k}|{slot}", t, CLASSES[t], "at", cells(i, [j for j in every if j != k]), cells(i, [k]))
            for i, c in enumerate(cutoffs) for k in folds for t, slot in targets.items()]


def decay_by_fold(at_cutoffs: DataFrame, names: Sequence[str], cutoffs: Sequence[int], cfg: StudyConfig, seed: int = 42,
                  folds: Sequence[int] | None = None) -> DataFrame:
    """(cutoff_days, fold, scores, difference): all cutoffs and folds fitted together, the same users in each. Every
    development user is scored unless some of the `folds` are named.

    `difference` is the macro-F1 less that of the first cutoff on the same users."""
    folds = range(cfg.n_folds) if folds is None else folds
    d = prepare(at_cutoffs, names, cutoff_splits(cutoffs, seed, cfg))
    scored = _named(_predicted(_run(d, _cutoff_fits(cutoffs, cfg, folds, {"y": "probs"}), ["y"])), "cutoff_days", "fold")
    block = M.score_block(scored, ["cutoff_days", "fold"])
    start = block.where(F.col("cutoff_days") == str(cutoffs[0])).select("fold", F.col("macro_f1").alias("_start"))
    return block.join(F.broadcast(start), "fold", "left").withColumn("difference", F.col("macro_f1") - F.col("_start")).drop("_start")


def two_stage_decay(at_cutoffs: DataFrame, names: Sequence[str], cutoffs: Sequence[int], tau: float, cfg: StudyConfig, seed: int = 42,
                    folds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(cutoff_days, derived, stage1, stage2): macro-F1 over out-of-fold rows of each cutoff at a fixed threshold."""
    d = prepare(at_cutoffs, names, cutoff_splits(cutoffs, seed, cfg))
    fits = _cutoff_fits(cutoffs, cfg, folds, {"renew": "renew_p", "move": "move_p"})
    scored = _named(_staged(_run(d, fits, ["y", "renewed", "move"])), "cutoff_days")
    views = F.explode(F.array(
        F.struct(F.lit("derived").alias("part"), F.col("y").alias("y"), M.threshold_class(F.col("p_renew"), F.col("movement"), F.lit(tau)).alias("p")),
        F.struct(F.lit("stage1").alias("part"), F.col("renewed").cast("int").alias("y"), (F.col("p_renew") >= 0.5).cast("int").alias("p")),
        F.struct(F.lit("stage2").alias("part"), F.col("move").cast("int").alias("y"), F.col("movement").alias("p"))))
    long = scored.select("cutoff_days", views.alias("v")).select("cutoff_days", "v.*").where(F.col("y").isNotNull())
    return M.score_block(long, ["cutoff_days", "part"]).groupBy("cutoff_days").pivot("part", ["derived", "stage1", "stage2"]).agg(F.first("macro_f1"))


def searched(score: Callable[[dict[str, dict]], DataFrame], configs: Sequence[dict], ledger: TrialLedger, at_once: int = 8) -> DataFrame:
    """The trial table of all configurations. `score` gives (model, scores) of those it is handed by name; `at_once` of
    them are fitted together and then committed one by one, so that a search that was lost goes on behind the last committed trial."""
    missing = ledger.missing(len(configs))
    for part in (missing[i : i + at_once] for i in range(0, len(missing), at_once)):
        scored = {r["model"]: r.asDict() for r in score({f"{i:04d}": configs[i] for i in part}).collect()}
        for i in part:
            found = scored[f"{i:04d}"]
            ledger.commit(i, {"trial": found.pop("model"), **configs[i], **found})
    return ledger.records(len(configs))


def random_search(d: Design, cfg: StudyConfig, grid: dict[str, Sequence], n: int, seed: int, ledger: TrialLedger, folds: Sequence[int] = (0, 1, 2),
                  at_once: int = 8) -> DataFrame:
    """The trial table of `n` draws from a grid of the logistic model's parameters."""
    return searched(lambda models: cross_validated(d, cfg, models, folds), draw_configs(grid, n, seed), ledger, at_once)


def best_trial(trials: DataFrame, params: Sequence[str], score: str = "macro_f1") -> dict:
    """Parameters of the best trial, the first one on ties."""
    best = trials.orderBy(F.desc(score), "trial").first()
    return {k: best[k] for k in params}


def _bins(rows: DataFrame, names: Sequence[str]) -> tuple[Binned, int]:
    return binned(rows, numeric_columns(names), categorical_columns(names)), len(numeric_columns(names))


def _boosts(name: str, target: str, cfg: StudyConfig, folds: Sequence[int], **params) -> list[Boost]:
    """One boosted model a fold, learned from all other folds and scoring its own: `name:fold`."""
    every = frozenset(range(cfg.n_folds))
    return [Boost(f"{name}:{k}", target, CLASSES[target], "user_fold", every - {k}, frozenset({k}), **params) for k in folds]


def boosted_trials(b: Binned, ordered: int, cfg: StudyConfig, models: dict[str, dict], folds: Sequence[int] = (0, 1, 2), target: str = "y") -> tuple[DataFrame, dict[str, Forest]]:
    """(model, scores over folds) of boosted classifiers given by their parameters, all folds of all models grown together, and the trees."""
    forests = boost_together(b, [f for name, params in models.items() for f in _boosts(name, target, cfg, folds, **params)], ordered, mixed=True)
    scored = boosted_scores(b, forests, [target]).withColumnRenamed("scores", "probs")
    return fold_means(M.score_block(_named(_predicted(scored, target), "model", "fold"), ["model", "fold"]), ["model"]), forests


def boosted_cv(rows: DataFrame, names: Sequence[str], cfg: StudyConfig, folds: Sequence[int] = (0, 1, 2), **params) -> tuple[DataFrame, dict[str, Forest]]:
    """(model, scores over folds) of boosted trees with a softmax over the classes, and the trees."""
    return boosted_trials(*_bins(rows, names), cfg, {"boosted": params}, folds)


def arm_trials(b: Binned, ordered: int, cfg: StudyConfig, models: dict[str, dict], arms: Sequence[str] = ARMS, folds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(model, arm, move_f1, move_f1_std, rmse) of boosted regression arms given by their parameters, over user-grouped folds of
    the renewers, all grown together. `b` has the rows of `arm_rows`."""
    grown = [f for name, params in models.items() for a in arms for f in _boosts(f"{name}:{a}", f"t_{a}", cfg, folds, **params)]
    forests = boost_together(b, grown, ordered, mixed=True)
    scored = _named(boosted_scores(b, forests, ["move", "pre_secs", "t_volume", "t_ratio"]), "model", "arm", "fold").withColumn("prediction", F.get("scores", F.lit(0)))
    scored = scored.withColumn("target", F.coalesce(*[F.when(F.col("arm") == a, F.col(f"t_{a}")) for a in arms]))
    ratio = F.coalesce(*[F.when(F.col("arm") == a, M.ratio_from_prediction(F.col("prediction"), F.col("pre_secs"), a)) for a in arms])
    pred = scored.where(F.col("move").isNotNull()).withColumns({"y": F.col("move").cast("int"), "p": M.ratio_to_movement(ratio, cfg)})
    keys = ["model", "arm", "fold"]
    scores = M.score_block(pred, keys).join(M.rmse(pred, "target", "prediction", keys), keys)
    return scores.groupBy("model", "arm").agg(F.avg("macro_f1").alias("move_f1"), F.stddev_pop("macro_f1").alias("move_f1_std"), F.avg("rmse").alias("rmse"))


def arm_rows(rows: DataFrame) -> DataFrame:
    """Renewers with what the arms predict."""
    return with_arms(rows).where(F.col("renewed") == 1)


def constant_arms(rows: DataFrame, cfg: StudyConfig) -> DataFrame:
    """(arm, scores, rmse) of the least that an arm has to beat: the mean target of the development renewers, predicted for every
    renewer of the holdout and turned into a movement."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"t_{a}").alias("target")) for a in ARMS]))
    long = arm_rows(rows).where(F.col("move").isNotNull()).select("is_holdout", "move", "pre_secs", each.alias("v")).select("is_holdout", "move", "pre_secs", "v.*")
    mean = long.where("is_holdout = 0").groupBy("arm").agg(F.avg("target").alias("prediction"))
    # One row an arm.
    held = long.where("is_holdout = 1").join(F.broadcast(mean), "arm")
    ratio = F.coalesce(*[F.when(F.col("arm") == a, M.ratio_from_prediction(F.col("prediction"), F.col("pre_secs"), a)) for a in ARMS])
    pred = held.withColumns({"y": F.col("move").cast("int"), "p": M.ratio_to_movement(ratio, cfg)})
    return M.score_block(pred, ["arm"]).join(M.rmse(pred, "target", "prediction", ["arm"]), "arm")


def boosted_arms(rows: DataFrame, names: Sequence[str], cfg: StudyConfig, folds: Sequence[int] = (0, 1, 2), **params) -> DataFrame:
    """(arm, move_f1, move_f1_std, rmse) of both boosted regression arms."""
    return arm_trials(*_bins(arm_rows(rows), names), cfg, {"boosted": params}, ARMS, folds).drop("model")


def boosted_search(rows: DataFrame, names: Sequence[str], cfg: StudyConfig, grid: dict[str, Sequence], n: int, seed: int, ledger: TrialLedger,
                   folds: Sequence[int] = (0, 1, 2), target: str = "y", at_once: int = 8) -> DataFrame:
    """The trial table of `n` draws from a grid of tree parameters, for the direct classifier (`y`) or a stage (`renew`, `move`).

    Bins are made once; folds of `at_once` trials grow together, whatever their depth and rounds."""
    b, ordered = _bins(rows, names)
    return searched(lambda models: boosted_trials(b, ordered, cfg, models, folds, target)[0], draw_configs(grid, n, seed), ledger, at_once)


def arm_search(rows: DataFrame, names: Sequence[str], cfg: StudyConfig, arm: str, grid: dict[str, Sequence], n: int, seed: int, ledger: TrialLedger,
               folds: Sequence[int] = (0, 1, 2), at_once: int = 8) -> DataFrame:
    """The trial table of `n` draws from a grid of tree parameters for one regression arm."""
    b, ordered = _bins(arm_rows(rows), names)
    return searched(lambda models: arm_trials(b, ordered, cfg, models, [arm], folds).drop("arm"), draw_configs(grid, n, seed), ledger, at_once)


def boosted_importance(rows: DataFrame, names: Sequence[str], cfg: StudyConfig, seeds: Sequence[int], **params) -> DataFrame:
    """(run, feature, gain): the mean gain of a feature's splits in the boosted classifier of each run, which learns from the run's
    development users; 0 for features without a split. All runs grow together over one set of bins."""
    b, ordered = _bins(rows.withColumns(seed_splits(seeds, cfg)), names)
    every = frozenset(range(cfg.n_folds))
    forests = boost_together(b, [Boost(str(s), "y", CLASSES["y"], f"run_{s}", every, frozenset({HELD}), **params) for s in seeds], ordered)
    mean = F.when(F.col("splits") > 0, F.col("gain") / F.col("splits")).otherwise(0.0)
    return gain_table(rows.sparkSession, forests, b.names).select(F.col("fit").cast("int").alias("run"), "feature", mean.alias("gain"))
