"""Queries over the study itself: cohort, renewal, usage, label, history, cutoffs."""

from pyspark.sql import functions as F

from renewscope.functions.scalar import flag, paid_renewal
from renewscope.config import ORDERS_STUDY
from renewscope.operators.audits import contract_checks, reconstruction_error
from renewscope.operators.cohort import distinct_transactions, expiry_events, transaction_days
from renewscope.operators.cutoff import transaction_features_at, usage_features_at
from renewscope.operators.explore import date_bounds, within_bounds
from renewscope.operators.labels import core
from renewscope.operators.members import with_demographics
from renewscope.operators.renewal import renewal_signals
from renewscope.operators.usage import cohort_usage, usage_days, usage_near, usage_windows
from renewscope.plans.catalog import query
from renewscope.plans.engineered import engineered_events, event_history, rebuilt_at_cutoffs
from renewscope.plans.labelled import labelled_events


def _txn(inp):
    return distinct_transactions(inp.transactions)


def _cohort(inp):
    return expiry_events(_txn(inp), inp.cfg)


def _usage(inp, events=None):
    cohort = _cohort(inp)
    days = cohort_usage(usage_days(usage_near(inp.usage, inp.cfg, None, inp.cfg.window_days), inp.cfg), cohort)
    return usage_windows(cohort.select("msno", "E", *(events or [])), days, inp.cfg)


_MONTH = "SELECT expiry_month, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY expiry_month) AS share"


@query("class_share_by_month", "expiry_month label n:i share:f",
       f"{_MONTH} FROM ev GROUP BY 1, 2")
def class_share_by_month(inp):
    from renewscope.operators.explore import crosstab_shares

    return crosstab_shares(labelled_events(inp), "expiry_month", "label")


@query("class_share_by_month_dense", "expiry_month label n:i share:f",
       f"{_MONTH} FROM ev GROUP BY 1, 2", study="events")
def class_share_by_month_dense(inp):
    return class_share_by_month(inp)


@query("transactions_union_dedup",
       "msno payment_method_id:i payment_plan_days:i plan_list_price:i actual_amount_paid:i is_auto_renew:i "
       "transaction_date:d membership_expire_date:d is_cancel:i", "SELECT * FROM txn", study="events")
def transactions_union_dedup(inp):
    # The second file repeats part of the first one: exact copies must vanish.
    again = inp.transactions.where(F.col("is_cancel") == 0)
    return distinct_transactions(inp.transactions, again)


@query("cohort_expiry_events",
       "msno E:d expiry_month last_pre_txn_date:d pre_list_price:i pre_amount_paid:i payment_plan_days:i "
       "payment_method_id:i is_auto_renew:i is_cancel:i", "SELECT * FROM cohort")
def cohort_expiry_events(inp):
    return _cohort(inp)


@query("known_at_expiry", "msno transaction_date:d membership_expire_date:d is_paid:i",
       "SELECT *, CAST(actual_amount_paid > 0 AND is_cancel = 0 AS INT) AS is_paid FROM txn "
       "WHERE transaction_date <= membership_expire_date AND membership_expire_date "
       "BETWEEN DATE '2024-01-09' AND DATE '2024-01-22'", study="events")
def known_at_expiry(inp):
    made, expire = F.col("transaction_date"), F.col("membership_expire_date")
    lo, hi = (F.lit(d).cast("date") for d in (inp.cfg.cohort_start, inp.cfg.cohort_end))
    return _txn(inp).where((made <= expire) & expire.between(lo, hi)).withColumn(
        "is_paid", paid_renewal(F.col("actual_amount_paid"), F.col("is_cancel")))


_RENEWAL = ("msno E:d n_grace_txns:i renewed_forward:i renewed_pre:i renewed:i pre_cov_end:d grace_end:d "
            "first_renewal_date:d post_list_price:f post_amount_paid:f")


@query("renewal_decision", _RENEWAL, "SELECT * FROM renewal")
def renewal_decision(inp):
    txn = _txn(inp)
    return renewal_signals(expiry_events(txn, inp.cfg), transaction_days(txn), inp.cfg)


@query("renewal_decision_dense", _RENEWAL, "SELECT * FROM renewal", study="events")
def renewal_decision_dense(inp):
    return renewal_decision(inp)


_WINDOWS = ("msno E:d pre_total_secs:g pre_n_days:i post_total_secs:g post_n_days:i pre_rate:g post_rate:g "
            "vol_ratio:f")


@query("usage_before_and_after", _WINDOWS, "SELECT * FROM usage")
def usage_before_and_after(inp):
    return _usage(inp)


@query("usage_before_and_after_dense", _WINDOWS, "SELECT * FROM usage", study="events")
def usage_before_and_after_dense(inp):
    return _usage(inp)


@query("horizon_features", "msno E:d " + " ".join(
    f"h{h}_secs:g h{h}_ndays:i h{h}_rate:g h{h}_active:f" for h in (1, 7, 14, 30, 60)), "SELECT * FROM usage")
def horizon_features(inp):
    return _usage(inp)


@query("horizon_features_dense", "msno E:d " + " ".join(
    f"h{h}_secs:g h{h}_ndays:i h{h}_rate:g h{h}_active:f" for h in (1, 3)), "SELECT * FROM usage", study="events")
def horizon_features_dense(inp):
    return _usage(inp)


@query("lifetime_and_recent_usage", "msno E:d obs_secs_full:g obs_ndays_full:i obs_secs_per_active_day:g " + " ".join(
    f"recent_secs_{c}:g recent_ndays_{c}:i" for c in (7, 14, 30, 60)), "SELECT * FROM usage")
def lifetime_and_recent_usage(inp):
    return _usage(inp)


@query("recent_vs_lifetime_ratio", "msno E:d obs_secs_per_active_day:g recent_vs_life_ratio:f", "SELECT * FROM ev")
def recent_vs_lifetime_ratio(inp):
    return _usage(inp)


@query("baseline_reconstruction", "n:i max_diff:f mean_diff:f",
       "SELECT 5 * count(*) AS n, 0.0 AS max_diff, 0.0 AS mean_diff FROM cohort")
def baseline_reconstruction(inp):
    cohort = _cohort(inp)
    days = cohort_usage(usage_days(usage_near(inp.usage, inp.cfg, None, inp.cfg.window_days), inp.cfg), cohort)
    wide = usage_windows(cohort.select("msno", "E"), days, inp.cfg)
    less = F.explode(F.array(*[
        F.struct(F.lit(c).alias("cutoff_days"),
                 (F.col("obs_secs_full") - (F.col(f"recent_secs_{c}") if c else F.lit(0.0))).alias("by_difference"))
        for c in inp.cfg.cutoffs
    ]))
    long = wide.select("msno", "E", less.alias("x")).select("msno", "E", "x.*")
    return reconstruction_error(long, usage_features_at(cohort, days, inp.cfg),
                                ["msno", "E", "cutoff_days"], "by_difference", "base_secs")


_LABEL = ("msno E:d label renewed:i vol_ratio:f is_silent_renewer:i has_pre_evidence:i has_post_evidence:i "
          "has_evidence:i post_observed_but_silent:i")


@query("trajectory_labels", _LABEL, "SELECT * FROM ev")
def trajectory_labels(inp):
    return labelled_events(inp)


@query("trajectory_labels_dense", _LABEL, "SELECT * FROM ev", study="events")
def trajectory_labels_dense(inp):
    return labelled_events(inp)


_HISTORY = ("n_hist_txns:f mean_hist_price:g median_hist_paid:f cancel_rate:f auto_renew_rate:f mode_pay_method:f "
            "tenure_days:f recency_days:f has_hist_txn:i n_prior_renewals:i n_prior_cancels:i n_prior_autorenew:i "
            "prior_renewal_rate:f")


@query("history_features", f"msno E:d {_HISTORY}", "SELECT * FROM at_cutoff WHERE cutoff_days = 0")
def history_features(inp):
    return event_history(inp)


_EVENT = ("pre_list_price:f pre_amount_paid:f payment_plan_days:f payment_method_id:f is_auto_renew:f is_cancel:f")


@query("cutoff_transaction_features", f"msno E:d cutoff_days:i {_EVENT} {_HISTORY}", "SELECT * FROM at_cutoff")
def cutoff_transaction_features(inp):
    txn = _txn(inp)
    return transaction_features_at(expiry_events(txn, inp.cfg), txn, transaction_days(txn), inp.cfg.cutoffs)


@query("cutoff_transaction_features_dense", f"msno E:d cutoff_days:i {_EVENT} {_HISTORY}",
       "SELECT * FROM at_cutoff", study="events")
def cutoff_transaction_features_dense(inp):
    return cutoff_transaction_features(inp)


def _cutoff_matrix_sql(cutoffs, mode="uniform"):
    def case(pick):
        return "CASE " + " ".join(f"WHEN a.cutoff_days = {c} THEN {pick(c)}" for c in cutoffs) + " END"

    own = ", ".join(
        f"CASE WHEN a.cutoff_days = 0 THEN e.{c} ELSE a.{c} END AS {c}"
        for c in ("pre_list_price", "pre_amount_paid", "payment_plan_days", "payment_method_id",
                  "is_auto_renew", "is_cancel"))
    return f"""
SELECT *, CASE WHEN obs_secs_per_active_day > 0 THEN pre_rate / obs_secs_per_active_day END AS recent_vs_life_ratio
FROM (SELECT *, CASE WHEN base_days > 0 THEN base_secs / base_days END AS obs_secs_per_active_day FROM (
  SELECT a.*EXCLUDE (pre_list_price, pre_amount_paid, payment_plan_days, payment_method_id, is_auto_renew, is_cancel),
  {own}, e.label,
  {case(lambda c: f"e.h{c}_secs" if c else "e.pre_total_secs")} AS pre_total_secs,
  {case(lambda c: f"e.h{c}_ndays" if c else "e.pre_n_days")} AS pre_n_days,
  {case(lambda c: f"e.h{c}_rate" if c else "e.pre_rate")} AS pre_rate,
  greatest(e.obs_secs_full - {case(lambda c: f"e.recent_secs_{c}" if c else "0")}, 0) AS base_secs,
  greatest(e.obs_ndays_full - {case(lambda c: f"e.recent_ndays_{c}" if c else "0")}, 0) AS base_days
  FROM at_cutoff a JOIN core e USING (msno, E)))"""


_MATRIX = (f"msno E:d cutoff_days:i label pre_total_secs:g pre_n_days:i pre_rate:g {_EVENT} {_HISTORY} "
           "obs_secs_per_active_day:g recent_vs_life_ratio:f")


@query("cutoff_feature_matrix", _MATRIX, _cutoff_matrix_sql((0, 7, 14, 30, 60)))
def cutoff_feature_matrix(inp):
    return rebuilt_at_cutoffs(inp)


@query("cutoff_feature_matrix_dense", _MATRIX, _cutoff_matrix_sql((0, 1, 3)), study="events")
def cutoff_feature_matrix_dense(inp):
    return rebuilt_at_cutoffs(inp)


_REFERENCE_NULLS = ("n_hist_txns", "has_hist_txn", "n_prior_renewals", "n_prior_cancels", "n_prior_autorenew",
                    "prior_renewal_rate")


@query("cutoff_features_reference_mode", "msno E:d cutoff_days:i n_hist_txns:f has_hist_txn:f n_prior_renewals:f "
       "prior_renewal_rate:f",
       "SELECT msno, E, cutoff_days, " + ", ".join(
           f"CASE WHEN cutoff_days > 0 AND payment_plan_days IS NULL THEN NULL ELSE {e} END AS {c}"
           for c, e in (("n_hist_txns", "CASE WHEN cutoff_days > 0 THEN coalesce(n_hist_txns, 0) ELSE n_hist_txns END"),
                        ("has_hist_txn", "has_hist_txn"), ("n_prior_renewals", "n_prior_renewals"),
                        ("prior_renewal_rate", "prior_renewal_rate"))) + " FROM at_cutoff")
def cutoff_features_reference_mode(inp):
    txn = _txn(inp)
    return transaction_features_at(expiry_events(txn, inp.cfg), txn, transaction_days(txn), inp.cfg.cutoffs,
                                   mode="reference")


@query("hidden_horizons_at_cutoff", "msno E:d cutoff_days:i " + " ".join(
    f"h{h}_secs:g h{h}_rate:g" for h in (1, 7, 14, 30, 60)),
       "SELECT msno, E, cutoff_days, " + ", ".join(
           f"CASE WHEN {h} >= cutoff_days THEN h{h}_{s} ELSE 0 END AS h{h}_{s}"
           for h in (1, 7, 14, 30, 60) for s in ("secs", "rate"))
       + " FROM usage JOIN decisions USING (msno, E)")
def hidden_horizons_at_cutoff(inp):
    from renewscope.operators.cutoff import hide_unknown_horizons

    cuts = F.explode(F.array(*[F.lit(c) for c in inp.cfg.cutoffs])).alias("cutoff_days")
    return hide_unknown_horizons(_usage(inp).select("*", cuts), inp.cfg, F.col("cutoff_days"))


@query("demographics_join", "msno E:d city:f bd:f gender registered_via:f registration_init_time:d",
       "SELECT c.msno, c.E, m.*EXCLUDE (msno) FROM cohort c LEFT JOIN members m USING (msno)")
def demographics_join(inp):
    return with_demographics(_cohort(inp), inp.members, inp.cfg)


@query("cohort_usage_semijoin", "msno n_days:i total:g",
       "SELECT msno, count(*) AS n_days, sum(total_secs) AS total FROM logs "
       "WHERE msno IN (SELECT msno FROM cohort) GROUP BY 1")
def cohort_usage_semijoin(inp):
    days = cohort_usage(usage_days(inp.usage, inp.cfg), _cohort(inp))
    return days.groupBy("msno").agg(
        F.count(F.lit(1)).alias("n_days"), (F.sum("d_micros") / 1_000_000).alias("total"))


@query("usage_within_cohort_bounds", "lo:d hi:d n:i",
       "SELECT min(b.lo) AS lo, max(b.hi) AS hi, count(*) AS n FROM logs, "
       "(SELECT min(E) - 180 AS lo, max(E) + 180 AS hi FROM cohort) b WHERE date BETWEEN b.lo AND b.hi")
def usage_within_cohort_bounds(inp):
    bounds = date_bounds(_cohort(inp), "E", inp.cfg.window_days, inp.cfg.window_days)
    kept = within_bounds(inp.usage, "date", bounds)
    return kept.agg(F.count(F.lit(1)).alias("n")).select(
        "n", bounds.select("lo").scalar().alias("lo"), bounds.select("hi").scalar().alias("hi"))


@query("label_contract_checks", "rule violations:i",
       "SELECT 'churn_iff_not_renewed' AS rule, count(*) FILTER (label <> 'INSUFFICIENT_DATA' AND (renewed = 0) <> (label = 'CHURN')) AS violations FROM ev "
       "UNION ALL SELECT 'movement_needs_evidence', count(*) FILTER (label <> 'INSUFFICIENT_DATA' AND has_pre_evidence = 0) FROM ev "
       f"UNION ALL SELECT 'stable_outside_band', count(*) FILTER (label = 'STABLE' AND vol_ratio NOT BETWEEN {ORDERS_STUDY.vol_low} AND {ORDERS_STUDY.vol_high}) FROM ev "
       "UNION ALL SELECT 'renewed_is_no_flag', count(*) FILTER (coalesce(renewed NOT IN (0, 1), true)) FROM ev")
def label_contract_checks(inp):
    return contract_checks(labelled_events(inp), inp.cfg)


@query("modellable_events", "msno E:d label renewed:i", "SELECT * FROM core", study="events")
def modellable_events(inp):
    return core(labelled_events(inp))


@query("silence_and_presence_flags", "msno E:d has_first:i has_ratio:i engaged:i",
       "SELECT msno, E, CAST(first_renewal_date IS NOT NULL AS INT) AS has_first, "
       "CAST(vol_ratio IS NOT NULL AS INT) AS has_ratio, "
       "coalesce(CAST(post_rate > pre_rate AS INT), 0) AS engaged FROM ev", study="events")
def silence_and_presence_flags(inp):
    ev = labelled_events(inp)
    return ev.select(
        "msno", "E", flag(F.col("first_renewal_date").isNotNull()).alias("has_first"),
        flag(F.col("vol_ratio").isNotNull()).alias("has_ratio"),
        flag(F.col("post_rate") > F.col("pre_rate")).alias("engaged"))


_ENGINEERED_COUNTS = ("SELECT count(*) AS n_events, count(*) FILTER (WHERE label <> 'INSUFFICIENT_DATA') AS n_modellable, "
                      "count(DISTINCT msno) AS n_users FROM ev")


@query("engineered_event_totals", "n_events:i n_modellable:i n_users:i", _ENGINEERED_COUNTS)
def engineered_event_totals(inp):
    return engineered_events(inp).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("is_modellable").alias("n_modellable"),
        F.countDistinct("msno").alias("n_users"))
