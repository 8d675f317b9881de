"""General operators against brute force, including heavily skewed keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from renewscope.config import MODEL_CLASSES, StudyConfig
from renewscope.operators import features as E
from renewscope.operators import metrics as M
from renewscope.operators.explore import describe_exact, histogram, missing_fractions, spearman
from renewscope.operators.history import history_medians
from renewscope.operators.panel import channel_totals, daily_panel, dense_sequence, normalise_sequences, slide
from renewscope.operators.quantiles import exact_quantiles, value_ranks
from renewscope.operators.ranges import binned_interval_join, plain_interval_join
from renewscope.operators.skew import join_unique
from renewscope.operators.splits import hash_sample, stratified_subsample

CFG = StudyConfig()


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        "g": np.where(rng.random(4000) < 0.4, "hot", rng.integers(0, 6, 4000).astype(str)),
        "x": np.round(rng.lognormal(3, 4, 4000) * rng.choice([-1, 1, 1], 4000), 3),
        "z": np.where(rng.random(4000) < 0.35, 0.0, rng.normal(size=4000)),
    })
    pdf["g"] = pdf["g"].where(pdf["g"] != "0", None)
    pdf["id"] = range(4000)
    pdf.loc[pdf["id"] % 17 == 0, "x"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x double, z double, id long")
    return pdf, df.repartition(5)


def test_exact_quantiles(numbers):
    pdf, df = numbers
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for col in ("x", "z"):
        got = {(r["g"], r["prob"]): (r["quantile"], r["n"]) for r in exact_quantiles(df, ["g"], col, probs).collect()}
        for g, part in pdf.groupby("g", dropna=False)[col]:
            values = part.dropna()
            for p in probs:
                q, n = got[(g if isinstance(g, str) else None, p)]
                assert n == len(values) and q == pytest.approx(values.quantile(p), rel=1e-12, abs=1e-12)
    whole = {r["prob"]: r["quantile"] for r in exact_quantiles(df, [], "x", probs).collect()}
    assert whole == pytest.approx({p: pdf["x"].quantile(p) for p in probs})


def test_value_ranks(numbers):
    pdf, df = numbers
    got = {r["z"]: (r["min_rank"], r["avg_rank"]) for r in value_ranks(df, [], "z").collect()}
    low, avg = pdf["z"].rank(method="min"), pdf["z"].rank()
    for v, a, b in zip(pdf["z"], low, avg):
        assert got[v] == (a, b)


def test_spearman(numbers):
    pdf, df = numbers
    got = {(r["a"], r["b"]): r["rho"] for r in spearman(df, ["x", "z"], ["id"]).collect()}
    want = pdf[["x", "z"]].dropna().rank().corr()
    assert got[("x", "z")] == pytest.approx(want.loc["x", "z"])
    assert got[("x", "x")] == pytest.approx(1.0)


def test_describe_histogram_missing(numbers):
    pdf, df = numbers
    r = {r["column"]: r for r in describe_exact(df, ["x", "z"]).collect()}["x"]
    d = pdf["x"].describe()
    assert (r["count"], r["mean"], r["std"], r["q25"], r["max"]) == pytest.approx(
        (d["count"], d["mean"], d["std"], d["25%"], d["max"]))
    counts = {r["bin"]: r["n"] for r in histogram(df, "z", -1.0, 1.0, 8).collect()}
    want, _ = np.histogram(pdf["z"], bins=8, range=(-1, 1))
    assert [counts.get(i, 0) for i in range(8)] == list(want)
    gone = {(r["g"], r["column"]): r["missing"] for r in missing_fractions(df, "g", ["x", "z"]).collect()}
    assert {c for _, c in gone} == {"x"}
    assert gone[("hot", "x")] == pytest.approx(pdf[pdf["g"] == "hot"]["x"].isna().mean())


def test_hot_user_history(spark):
    """A user with a third of all rows and continuous amounts."""
    rng = np.random.default_rng(11)
    n = 3000
    pdf = pd.DataFrame({"msno": np.where(np.arange(n) % 3 == 0, "hot", (np.arange(n) % 40).astype(str)),
                        "day": rng.integers(0, 120, n), "paid": np.round(rng.lognormal(8, 2, n)).astype(int)})
    pdf.loc[pdf["day"] % 11 == 0, "paid"] = 0
    base = F.lit("2016-01-01").cast("date")
    txn = spark.createDataFrame(pdf).select("msno", F.date_add(base, F.col("day").cast("int")).alias("transaction_date"),
                                            F.col("paid").alias("actual_amount_paid"))
    points = txn.select("msno").distinct().select("msno", F.explode(F.sequence(F.lit(0), F.lit(125), F.lit(9))).alias("d"))
    points = points.withColumn("dec", F.date_add(base, F.col("d")))
    medians = history_medians(points, txn)
    day0 = pd.Timestamp("2016-01-01").date()
    for found in (medians,):
        got = {(r["msno"], (r["dec"] - day0).days): r["median_hist_paid"] for r in found.collect()}
        want = {}
        for user, part in pdf.groupby("msno"):
            for d in range(0, 126, 9):
                past = part[part["day"] < d]["paid"]
                if len(past):
                    want[(user, d)] = past.median()
        assert got == want


def test_join_unique_keeps_every_row(numbers):
    _, df = numbers
    lookup = df.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    joined = join_unique(df, lookup, ["z"], "n")
    assert joined.count() == df.count()
    assert joined.exceptAll(df.join(lookup, "z").select(joined.columns)).count() == 0


def test_binned_join_equals_plain_join(spark):
    day = lambda c: F.date_add(F.lit("1969-06-01").cast("date"), c)  # noqa: E731  crosses day 0
    facts = spark.range(900).select((F.col("id") % 3).cast("string").alias("msno"), day((F.col("id") % 400).cast("int")).alias("date"))
    points = spark.range(60).select((F.col("id") % 4).cast("string").alias("msno"), day((F.col("id") * 7).cast("int")).alias("E"))
    lo, hi = F.date_sub("E", 45), F.date_add("E", 3)
    got = binned_interval_join(facts, points, lo, hi, bin_days=32)
    want = plain_interval_join(facts, points, lo, hi).select(got.columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_dense_sequence_and_slide(spark):
    events = spark.createDataFrame([("a", "2017-01-01"), ("a", "2017-01-01"), ("b", "2017-01-01")], "msno string, E string")
    events = events.withColumn("E", F.col("E").cast("date"))
    logs = spark.createDataFrame(
        [("a", "2016-12-31", 5.0, 1, 2, 3), ("a", "2016-12-20", 9.0, 4, 5, 6), ("a", "2016-12-01", 1.0, 1, 1, 1)],
        "msno string, date string, total_secs double, num_100 long, num_unq long, num_25 long")
    logs = logs.withColumn("date", F.col("date").cast("date"))
    panel = daily_panel(events.distinct(), logs, CFG, 24)
    dense = dense_sequence(panel, events, 24)
    got = {r["msno"]: r["seq"] for r in dense.withColumn("seq", F.col("seq")).collect()}
    assert set(got) == {"a", "b"} and all(len(s) == 24 for s in got.values())
    assert got["a"][23] == [5.0, 1.0, 2.0, 3.0] and got["a"][12] == [9.0, 4.0, 5.0, 6.0]
    assert sum(x != [0.0] * 4 for x in got["a"]) == 2 and not any(any(x) for x in got["b"])
    last = dense.where("msno = 'a'").select(slide(F.col("seq"), 24, 12, 3)).first()[0]
    assert last == got["a"][9:21]


def _scores(y, p):
    labels = sorted(set(y) | set(p))
    f1, recall, support = {}, {}, {}
    for c in labels:
        tp = sum(a == b == c for a, b in zip(y, p))
        support[c], predicted = y.count(c), p.count(c)
        f1[c] = 2 * tp / (support[c] + predicted)
        if support[c]:
            recall[c] = tp / support[c]
    n = len(y)
    return (sum(a == b for a, b in zip(y, p)) / n, np.mean(list(recall.values())), np.mean(list(f1.values())),
            sum(f1[c] * support[c] for c in labels) / n)


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 3, 500).tolist(), rng.integers(0, 4, 500).tolist()
    s, m = np.round(rng.random(500), 2).tolist(), rng.integers(0, 3, 500).tolist()
    return (y, p, s, m), spark.createDataFrame(list(zip(y, p, s, m)), "y int, p int, p_renew double, movement int")


def test_scores(predictions):
    (y, p, _, _), df = predictions
    r = M.score_block(df).first()
    assert tuple(r)[:4] == pytest.approx(_scores(y, p)) and r["n"] == 500
    report = {r["class"]: r for r in M.classification_report(df, MODEL_CLASSES).collect()}
    assert report["EXPANSION"]["support"] == 0 and report["EXPANSION"]["precision"] == 0.0
    assert report["accuracy"]["f1"] == pytest.approx(r["accuracy"])
    grid = M.confusion_matrix(df, 4).collect()
    assert len(grid) == 16 and sum(r["n"] for r in grid) == 500


def test_tau_scores_equal_one_evaluation_per_threshold(predictions):
    (y, _, s, m), df = predictions
    got = {round(r["tau"], 3): r["macro_f1"] for r in M.tau_scores(df).collect()}
    assert len(got) == 33
    for tau in (0.1, 0.475, 0.9):
        pred = [0 if a < min(M.TAU_GRID, key=lambda t: abs(t - tau)) else b + 1 for a, b in zip(s, m)]
        assert got[tau] == pytest.approx(_scores(y, pred)[2])
    best = M.best_tau(df).first()
    assert best["macro_f1"] == max(got.values())


def test_ranking_scores(predictions):
    (y, _, s, _), df = predictions
    r = M.ranking_scores(df.withColumn("pos", (F.col("y") == 0).cast("int")), "p_renew", "pos").first()
    pos = [a for a, c in zip(s, y) if c == 0]
    neg = [a for a, c in zip(s, y) if c != 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert r["roc_auc"] == pytest.approx(auc)
    ap, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit, shown = sum(a >= t for a in pos), sum(a >= t for a in s)
        ap += (hit / len(pos) - before) * hit / shown
        before = hit / len(pos)
    assert r["average_precision"] == pytest.approx(ap)


def test_stratified_subsample(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("label"))
    one = stratified_subsample(df, "label", 333, ["id"], 1)
    sizes = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    assert sizes == {"a": 233, "b": 67, "c": 33}
    again = stratified_subsample(df.repartition(7), "label", 333, ["id"], 1)
    assert {r["id"] for r in one.collect()} == {r["id"] for r in again.collect()}
    assert stratified_subsample(df, "label", 9000, ["id"], 1).count() == 5000
    assert hash_sample(df, 40, ["id"], 3).count() == 40


def test_impute_scale_encode(numbers, spark):
    pdf, df = numbers
    filled = E.impute_medians(df, E.fit_medians(df, ["x"]), ["x"])
    assert filled.where("x is null").count() == 0
    scaled = E.standardise(filled, E.fit_scaling(filled, ["x"]), ["x"]).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert tuple(scaled) == pytest.approx((0.0, 1.0), abs=1e-6)
    levels = E.level_table(df.where("g <> '3'"), "g")
    coded = {r["g"]: r["c"] for r in E.encode_levels(df, "g", levels, "c").select("g", "c").distinct().collect()}
    assert coded == {"1": 0, "2": 1, "4": 2, "5": 3, "hot": 4, "3": 5, None: 5}
    rare = {r["lv"] for r in E.group_rare_levels(df, "g", "lv", 1000).select("lv").distinct().collect()}
    assert rare == {"hot", "infrequent"}
    weights = {r["g"]: r["weight"] for r in E.balanced_weights(df.where("g is not null"), "g").collect()}
    known = pdf.dropna(subset=["g"])
    assert weights["hot"] == pytest.approx(len(known) / (6 * (known["g"] == "hot").sum()))


def test_importance_and_baselines(spark):
    imp = spark.createDataFrame([(r, f"f{i}", float(20 - i + (r * i) % 3)) for r in range(3) for i in range(14)],
                                "run int, feature string, gain double")
    shares = M.importance_shares(imp)
    assert M.sum_to_one(shares).where("ok = 0").count() == 0
    assert M.importance_overlap(shares, 0).first()["overlap"] >= 8
    assert "f0" in {r[0] for r in M.in_every_run(M.importance_robustness(shares)).collect()}
    train = spark.createDataFrame([(0,)] * 3 + [(1,)] * 6 + [(2,)], "y int")
    test = spark.range(1000).select((F.col("id") % 3).cast("int").alias("y"), ((F.col("id") + 0.5) / 1000).alias("u"))
    drawn = M.baseline_predictions(train, test, F.col("u"))
    assert {(r["strategy"], r["p"]): r["n"] for r in drawn.groupBy("strategy", "p").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        ("most_frequent", 1): 1000, ("prior", 1): 1000, ("stratified", 0): 300, ("stratified", 1): 600, ("stratified", 2): 100}


def test_normalised_totals_compute_a_sequence_once(spark, tmp_path):
    seqs = [[[0.0, 1.0], [5.0, None]], [[70_000.0, 2.0]], [], None]
    spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)], "msno string, seq array<array<float>>").write.parquet(
        f"{tmp_path}/dense")
    spark.createDataFrame([("b", 0.5, 2.0), ("a", 1.0, 4.0)], "channel string, mean double, std double").write.parquet(
        f"{tmp_path}/stats")
    dense, stats = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("dense", "stats"))
    scaled = normalise_sequences(dense, stats, CFG, ["a", "b"])
    logged = lambda x, mean, std: (np.log1p(min(x, CFG.seq_clip)) - mean) / std
    want = {r["msno"]: r["seq"] for r in scaled.collect()}
    assert want["2"] == [] and want["3"] is None
    assert want["0"][1] == pytest.approx([logged(5, 1, 4), logged(0, 0.5, 2)])
    assert want["1"][0] == pytest.approx([logged(70_000, 1, 4), logged(2, 0.5, 2)])
    totals = channel_totals(scaled, ["a", "b"])
    got = {r["channel"]: r["total"] for r in totals.collect()}
    assert got == pytest.approx({c: sum(day[i] for s in want.values() for day in s or []) for i, c in enumerate("ab")})
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == plan.count("aggregate(seq") + plan.count("aggregate(transform") == 1 and "map_from_entries" not in plan
