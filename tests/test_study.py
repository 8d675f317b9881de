"""Edge rows of the study rules, worked out by hand."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from renewscope.config import StudyConfig
from renewscope.functions.scalar import keep_between, md5_mod, parse_yyyymmdd, trajectory_label
from renewscope.operators.audits import label_agreement, official_churn
from renewscope.operators.cohort import distinct_transactions, expiry_events, transaction_days
from renewscope.operators.cutoff import cutoff_matrix, transaction_features_at
from renewscope.operators import history
from renewscope.operators.history import with_history
from renewscope.operators.members import with_demographics
from renewscope.operators.renewal import renewal_signals
from renewscope.operators.splits import assign_all_run_splits, assign_run_split, split_leaks
from renewscope.operators.usage import usage_days, usage_windows

CFG = StudyConfig()
E0 = date(2016, 12, 1)
TXN = ("msno string, payment_method_id long, payment_plan_days long, plan_list_price long, actual_amount_paid long, "
       "is_auto_renew long, transaction_date date, membership_expire_date date, is_cancel long")


def txn(user, made, expire, paid=149, cancel=0, method=41, price=149, auto=1, plan=30):
    return (user, method, plan, price, paid, auto, made, expire, cancel)


def day(n):
    return E0 + timedelta(days=n)


def test_label_rule(spark):
    # Evidence days, renewed, seconds before, seconds after, expected class.
    cases = [
        (6, 1, 100.0, 100.0, "INSUFFICIENT_DATA"), (6, 0, 100.0, 0.0, "INSUFFICIENT_DATA"),
        (7, 0, 100.0, 500.0, "CHURN"), (7, 1, 100.0, 0.0, "CONTRACTION"), (7, 1, 0.0, 0.0, "CONTRACTION"),
        (7, 1, 0.0, 50.0, "INSUFFICIENT_DATA"), (7, 1, 100.0, 49.9, "CONTRACTION"), (7, 1, 100.0, 50.0, "STABLE"),
        (7, 1, 100.0, 150.0, "STABLE"), (7, 1, 100.0, 150.1, "EXPANSION"),
    ]
    df = spark.createDataFrame(cases, "pre_n_days int, renewed int, pre double, post_total_secs double, want string")
    df = df.withColumn("vol_ratio", F.when(F.col("pre") > 0, F.col("post_total_secs") / F.col("pre")))
    wrong = df.withColumn("label", trajectory_label(CFG)).where("label <> want")
    assert wrong.count() == 0


def test_renewal_edges(spark):
    base = lambda u: txn(u, day(-30), E0)
    rows = [
        base("on"), txn("on", day(0), day(30)),
        base("last"), txn("last", day(30), day(60)),
        base("late"), txn("late", day(31), day(61)),
        base("free"), txn("free", day(5), day(35), paid=0),
        base("cancel"), txn("cancel", day(5), day(35), cancel=1),
        base("early"), txn("early", day(-3), day(27), paid=0),
        base("same"), txn("same", day(-3), E0, paid=0, price=1),
    ]
    t = spark.createDataFrame(rows, TXN)
    got = {r["msno"]: r for r in renewal_signals(expiry_events(t, CFG), transaction_days(t), CFG).collect()
           if r["E"] == E0}
    assert {u: r["renewed"] for u, r in got.items()} == {
        "on": 1, "last": 1, "late": 0, "free": 0, "cancel": 0, "early": 1, "same": 0}
    assert got["free"]["n_grace_txns"] == 1 and got["late"]["n_grace_txns"] == 0
    assert got["on"]["first_renewal_date"] == E0 and got["late"]["first_renewal_date"] is None
    assert got["early"]["pre_cov_end"] == day(27)


def test_cohort_rules(spark):
    rows = [
        txn("a", day(-30), E0), txn("a", day(-30), E0),          # exact copies
        txn("a", day(-10), E0, paid=99),                          # later row wins
        txn("a", day(2), E0, cancel=1),                           # not known at E
        txn("b", day(-5), date(2017, 1, 31)), txn("c", day(-5), date(2017, 2, 1)),
        txn("d", day(-5), date(2016, 8, 1)),                      # made after its expiry
    ]
    t = distinct_transactions(spark.createDataFrame(rows[:3], TXN), spark.createDataFrame(rows[1:], TXN))
    assert t.count() == 6
    got = {(r["msno"], r["E"]): r for r in expiry_events(t, CFG).collect()}
    assert set(got) == {("a", E0), ("b", date(2017, 1, 31))}
    assert got[("a", E0)]["pre_amount_paid"] == 99 and got[("a", E0)]["expiry_month"] == "2016-12"


def test_same_day_tie_does_not_depend_on_order(spark):
    rows = [txn("a", day(-1), E0, paid=p, price=q) for p, q in ((100, 1), (149, 5), (149, 7))]
    for order in (rows, rows[::-1]):
        r = expiry_events(spark.createDataFrame(order, TXN), CFG).first()
        assert (r["pre_amount_paid"], r["pre_list_price"]) == (149, 7)


def test_usage_windows_edges(spark):
    logs = [("a", day(d), s) for d, s in (
        (-31, 1.0), (-30, 10.0), (-1, 100.0), (0, 1000.0), (1, 5.0), (30, 7.0), (31, 9.0),
        (-2, -5.0), (-3, 90000.0), (-4, None), (-40, 2.5), (-40, 3.5))]
    events = spark.createDataFrame([("a", E0), ("none", E0)], "msno string, E date")
    days = usage_days(spark.createDataFrame(logs, "msno string, date date, total_secs double"), CFG)
    got = {r["msno"]: r for r in usage_windows(events, days, CFG).collect()}
    a = got["a"]
    assert a["pre_total_secs"] == 10 + 100 + 0 + 86400 and a["pre_n_days"] == 5
    assert a["post_total_secs"] == 12.0 and a["post_n_days"] == 2
    # Horizon 1 covers offsets -31 … -2; horizon 14 covers -44 … -15.
    assert a["h1_secs"] == 1 + 10 + 86400 and a["h1_ndays"] == 5
    assert a["h14_secs"] == 1 + 10 + 6 and a["h14_ndays"] == 4   # two rows on day -40 count twice
    assert a["obs_ndays_full"] == 8 and a["recent_secs_7"] == 100 + 86400
    assert a["vol_ratio"] == pytest.approx(12.0 / a["pre_total_secs"])
    none = got["none"]
    assert none["pre_n_days"] == 0 and none["pre_rate"] is None and none["vol_ratio"] is None
    assert none["h1_secs"] == 0 and none["h1_rate"] is None and none["h1_active"] == 0


def test_history_mode_median_and_missing(spark):
    rows = [txn("a", day(-d), day(-d + 30), paid=p, method=m) for d, p, m in
            ((100, 10, 41), (80, 20, 38), (60, 30, 38), (40, 100, 41))]
    rows.append(txn("a", E0, day(30), paid=7, method=5))          # on E: not history
    t = spark.createDataFrame(rows, TXN)
    points = spark.createDataFrame([("a", E0), ("new", E0)], "msno string, E date")
    got = {r["msno"]: r for r in with_history(points, t, transaction_days(t), at="E").collect()}
    a, new = got["a"], got["new"]
    assert a["mode_pay_method"] == 38 and a["median_hist_paid"] == 25.0
    assert (a["n_hist_txns"], a["tenure_days"], a["recency_days"]) == (4, 100, 40)
    assert a["prior_renewal_rate"] == 1.0 and a["payment_method_id"] == 5
    assert new["n_hist_txns"] is None and new["has_hist_txn"] == 0 and new["prior_renewal_rate"] == 0.0


def test_histories_of_few_and_many_transactions_agree(spark, monkeypatch):
    rows = [txn(u, day(-d), day(-d + 30), paid=(7 * d) % 11, method=(d % 3) or None) for u, n in (("a", 9), ("b", 40)) for d in range(1, n)]
    rows.append(txn(None, day(-5), E0, paid=3, method=1))
    t = spark.createDataFrame(rows, TXN)
    points = spark.createDataFrame([(u, day(-c)) for u in ("a", "b", "new") for c in (0, 5, 6, 30)], "msno string, E date")
    found = []
    for bound in (0, 20, 256):
        monkeypatch.setattr(history, "GATHERED", bound)
        found.append(sorted(map(str, with_history(points, t, transaction_days(t), at="E").select(
            "msno", "E", "median_hist_paid", "mode_pay_method", "n_hist_txns").collect())))
    assert found[0] == found[1] == found[2]


def test_cohort_rows_are_not_broadcast(spark, capsys):
    rows = [txn(f"u{i}", day(-90 - i), day(-i), paid=i, method=1) for i in range(20)]
    t = spark.createDataFrame(rows, TXN)
    points = spark.createDataFrame([(f"u{i}", day(-i)) for i in range(20)], "msno string, E date")
    with_history(points, t, transaction_days(t), at="E").explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_cutoff_modes(spark):
    rows = [txn("a", day(-5), E0), txn("b", day(-40), day(-10)), txn("b", day(-3), E0)]
    t = spark.createDataFrame(rows, TXN)
    events = expiry_events(t, CFG).where(F.col("E") == F.lit(E0))
    for mode, want in (("uniform", (None, 0)), ("reference", (None, None))):
        got = {(r["msno"], r["cutoff_days"]): r for r in transaction_features_at(
            events, t, transaction_days(t), CFG.cutoffs, mode).collect()}
        # a's only transaction falls after E - 7.
        assert (got[("a", 7)]["n_hist_txns"], got[("a", 7)]["has_hist_txn"]) == want
        assert got[("a", 7)]["payment_plan_days"] is None
        assert got[("b", 7)]["recency_days"] == 33 and got[("b", 0)]["n_hist_txns"] == 2
    assert got[("b", 60)]["n_prior_renewals"] is None
    with pytest.raises(ValueError):
        transaction_features_at(events, t, transaction_days(t), CFG.cutoffs, "other")


def test_baseline_is_null_when_all_usage_is_recent(spark):
    t = spark.createDataFrame([txn("a", day(-20), E0)], TXN)
    events = expiry_events(t, CFG)
    logs = spark.createDataFrame([("a", day(-2), 60.0)], "msno string, date date, total_secs double")
    wide = usage_windows(events, usage_days(logs, CFG), CFG)
    got = {r["cutoff_days"]: r for r in cutoff_matrix(wide, t, transaction_days(t), CFG).collect()}
    assert got[0]["obs_secs_per_active_day"] == 60.0 and got[0]["recent_vs_life_ratio"] == 1.0
    assert got[7]["obs_secs_per_active_day"] is None and got[7]["pre_total_secs"] == 0


def test_members(spark):
    members = spark.createDataFrame(
        [(u, 1, b, None, 7, d) for u, b, d in (("a", 9, 20161331), ("b", 10, 20160101), ("c", 90, 20160229), ("d", 91, 20150229))],
        "msno string, city long, bd long, gender string, registered_via long, registration_init_time long")
    events = spark.createDataFrame([(u, E0) for u in "abcde"], "msno string, E date")
    got = {r["msno"]: (r["bd"], r["registration_init_time"]) for r in with_demographics(events, members, CFG).collect()}
    assert got == {"a": (None, None), "b": (10, date(2016, 1, 1)), "c": (90, date(2016, 2, 29)), "d": (None, None),
                   "e": (None, None)}


def test_dates_and_ages(spark):
    df = spark.createDataFrame([(20161331, 0), (20160101, 101)], "d long, a long")
    got = df.select(parse_yyyymmdd(F.col("d"), strict=False), keep_between(F.col("a"), *CFG.age_use)).collect()
    assert [tuple(r) for r in got] == [(None, 0), (date(2016, 1, 1), None)]
    with pytest.raises(Exception):
        df.select(parse_yyyymmdd(F.col("d"))).collect()


def test_user_hash_matches_python(spark):
    import hashlib

    users = [f"user-{i}=" for i in range(200)]
    df = spark.createDataFrame([(u,) for u in users], "msno string")
    for m in (5, 1000, 1_000_000):
        got = {r[0]: r[1] for r in df.select("msno", md5_mod(F.col("msno"), m)).collect()}
        assert got == {u: int(hashlib.md5(u.encode()).hexdigest(), 16) % m for u in users}
    run = {r["msno"]: (r["is_holdout"], r["user_fold"]) for r in assign_run_split(df, 42, CFG).collect()}

    def u(salt, user):
        return (int(hashlib.md5(f"{salt}:{user}".encode()).hexdigest(), 16) % 1_000_000) / 1_000_000

    want = {x: (1, -1) if u("ho:42", x) < 0.15 else (0, int(u("fold:42", x) * 5)) for x in users}
    assert run == want
    every = assign_all_run_splits(df, CFG)
    assert every.count() == 1000
    assert split_leaks(every.where("seed = 45")).count() == 0


def test_official_churn_brute_force(spark):
    rows = [
        txn("keep", date(2017, 1, 10), date(2017, 2, 9)), txn("keep", date(2017, 2, 20), date(2017, 3, 20), paid=0),
        txn("gap", date(2017, 1, 10), date(2017, 2, 9)), txn("gap", date(2017, 3, 11), date(2017, 4, 9)),
        txn("gone", date(2017, 1, 10), date(2017, 2, 9)),
        txn("pulled", date(2017, 1, 10), date(2017, 2, 28)), txn("pulled", date(2017, 2, 5), date(2017, 2, 6), cancel=1),
        txn("pulled", date(2017, 3, 20), date(2017, 4, 20)),
        txn("outside", date(2017, 1, 10), date(2017, 3, 9)),
    ]
    t = spark.createDataFrame(rows, TXN)
    pred = official_churn(t, ("2017-01-01", "2017-01-31"), ("2017-02-01", "2017-02-28"))
    got = {r["msno"]: (r["gap"], r["pred_churn"]) for r in pred.collect()}
    assert got == {"keep": (11, 0), "gap": (30, 1), "gone": (None, 1), "pulled": (42, 1)}
    truth = spark.createDataFrame([("keep", 0), ("gap", 0), ("gone", 1), ("missing", 1)], "msno string, is_churn int")
    r = label_agreement(truth, pred).first()
    assert (r["n_truth"], r["n_matched"], r["accuracy"]) == (4, 3, pytest.approx(2 / 3))
