"""Queries that audit the label."""

from pyspark.sql import functions as F

from renewscope.operators import audits as A
from renewscope.operators.cohort import distinct_transactions, transaction_days
from renewscope.plans.catalog import query
from renewscope.plans.labelled import labelled_events


def _all(inp):
    txn = distinct_transactions(inp.transactions)
    return labelled_events(inp), txn, transaction_days(txn)


_CLASSES = "['CHURN', 'CONTRACTION', 'STABLE', 'EXPANSION', 'INSUFFICIENT_DATA']"


@query("class_distribution_all_vs_core", "label n:i all_share:f core_share:f", f"""
SELECT c.label, count(e.msno) AS n, count(e.msno) / (SELECT count(*) FROM ev) AS all_share,
  count(e.msno) FILTER (WHERE c.label <> 'INSUFFICIENT_DATA') / (SELECT count(*) FROM core) AS core_share
FROM (SELECT unnest({_CLASSES}) AS label) c LEFT JOIN ev e USING (label) GROUP BY 1""")
def class_distribution_all_vs_core(inp):
    return A.class_distribution(labelled_events(inp))


@query("monthly_summary", "expiry_month events:i renewal_rate:f mean_pre_rate:g mean_post_rate:g core_rate:f", """
SELECT expiry_month, count(*) AS events, avg(renewed) AS renewal_rate, avg(pre_rate) AS mean_pre_rate,
  avg(post_rate) AS mean_post_rate, avg(CAST(label <> 'INSUFFICIENT_DATA' AS INT)) AS core_rate
FROM ev GROUP BY 1""")
def monthly_summary(inp):
    return A.monthly_summary(labelled_events(inp))


@query("monthly_class_mix", "expiry_month label n:i share:f", """
SELECT expiry_month, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY expiry_month) AS share
FROM core GROUP BY 1, 2""")
def monthly_class_mix(inp):
    return A.monthly_class_mix(labelled_events(inp))


_AUDIT = {
    "total_events": "true", "any_pre_day": "pre_n_days > 0", "pre_evidence": "pre_n_days >= 3",
    "any_post_day": "post_n_days > 0", "post_evidence": "post_n_days >= 3", "both_evidence": "has_evidence = 1",
    "renewed": "renewed = 1", "silent_renewer": "is_silent_renewer = 1",
    "post_observed_but_silent": "post_observed_but_silent = 1",
    "pre_zero_post_positive": "pre_rate = 0 AND post_rate > 0", "insufficient_data": "label = 'INSUFFICIENT_DATA'",
}


@query("data_quality_audit", "metric n:i pct:f", " UNION ALL ".join(
    f"SELECT '{k}' AS metric, count(*) FILTER (WHERE {c}) AS n, "
    f"round_even(count(*) FILTER (WHERE {c}) / count(*) * 100, 2) AS pct FROM ev" for k, c in _AUDIT.items()))
def data_quality_audit(inp):
    return A.quality_audit(labelled_events(inp), inp.cfg)


@query("threshold_sweep", "tau:f flip_rate:f stable_of_core:f share_stable:f share_expansion:f share_contraction:f", """
SELECT tau, avg(CAST(a <> b AS INT)) AS flip_rate,
  count(*) FILTER (WHERE a = 'STABLE') / (SELECT count(*) FROM core) AS stable_of_core,
  avg(CAST(a = 'STABLE' AS INT)) AS share_stable, avg(CAST(a = 'EXPANSION' AS INT)) AS share_expansion,
  avg(CAST(a = 'CONTRACTION' AS INT)) AS share_contraction
FROM (SELECT tau,
    CASE WHEN vol_ratio < 1 - tau THEN 'CONTRACTION' WHEN vol_ratio > 1 + tau THEN 'EXPANSION' ELSE 'STABLE' END AS a,
    CASE WHEN vol_ratio < 0.5 THEN 'CONTRACTION' WHEN vol_ratio > 1.5 THEN 'EXPANSION' ELSE 'STABLE' END AS b
  FROM ev, (SELECT CAST(unnest(range(20, 81, 5)) AS DOUBLE) / CAST(100 AS DOUBLE) AS tau)
  WHERE has_pre_evidence = 1 AND renewed = 1 AND vol_ratio IS NOT NULL) GROUP BY 1""")
def threshold_sweep(inp):
    return A.threshold_sweep(labelled_events(inp), inp.cfg)


@query("intensity_label_flips", "label intensity_label n:i flipped:i", """
SELECT label, intensity_label, count(*) AS n, CAST(label <> intensity_label AS INT) AS flipped FROM (
  SELECT label, CASE WHEN post_total_secs = 0 THEN 'CONTRACTION' WHEN post_rate / pre_rate < 0.5 THEN 'CONTRACTION'
    WHEN post_rate / pre_rate > 1.5 THEN 'EXPANSION' ELSE 'STABLE' END AS intensity_label
  FROM ev WHERE label IN ('CONTRACTION', 'STABLE', 'EXPANSION')) GROUP BY 1, 2""")
def intensity_label_flips(inp):
    return A.intensity_flips(labelled_events(inp), inp.cfg)


@query("sparse_post_renewers", "n:i n_zero:i n_some:i contraction_share:f median_ratio:f", """
SELECT count(*) AS n, count(*) FILTER (WHERE post_n_days = 0) AS n_zero,
  count(*) FILTER (WHERE post_n_days BETWEEN 1 AND 2) AS n_some,
  avg(CAST(label = 'CONTRACTION' AS INT)) AS contraction_share, median(vol_ratio) AS median_ratio
FROM ev WHERE renewed = 1 AND pre_n_days >= 3 AND post_n_days < 3""")
def sparse_post_renewers(inp):
    return A.sparse_post_summary(labelled_events(inp), inp.cfg)


@query("sparse_post_label_mix", "label n:i",
       "SELECT label, count(*) AS n FROM ev WHERE renewed = 1 AND pre_n_days >= 3 AND post_n_days < 3 GROUP BY 1")
def sparse_post_label_mix(inp):
    return A.sparse_post_labels(labelled_events(inp), inp.cfg)


@query("engaged_churn_summary", "n_churn:i n_active:i active_of_churn:f active_of_all:f active_of_core:f "
       "volume_share:f auto_renew_rate:f cancel_rate:f", """
SELECT count(*) FILTER (WHERE churn) AS n_churn, count(*) FILTER (WHERE act) AS n_active,
  count(*) FILTER (WHERE act) / count(*) FILTER (WHERE churn) AS active_of_churn,
  count(*) FILTER (WHERE act) / count(*) AS active_of_all,
  count(*) FILTER (WHERE act) / count(*) FILTER (WHERE label <> 'INSUFFICIENT_DATA') AS active_of_core,
  sum(post_total_secs) FILTER (WHERE act) / sum(post_total_secs) AS volume_share,
  avg(is_auto_renew) FILTER (WHERE act) AS auto_renew_rate, avg(is_cancel) FILTER (WHERE act) AS cancel_rate
FROM (SELECT *, label = 'CHURN' AS churn, label = 'CHURN' AND post_total_secs > 0 AS act FROM ev)""")
def engaged_churn_summary(inp):
    return A.engaged_churn_summary(labelled_events(inp))


@query("engaged_churn_medians", "column_name median:g", """
SELECT 'post_total_secs' AS column_name, median(post_total_secs) AS median FROM ev WHERE label = 'CHURN' AND post_total_secs > 0
UNION ALL SELECT 'post_n_days', median(post_n_days) FROM ev WHERE label = 'CHURN' AND post_total_secs > 0
UNION ALL SELECT 'vol_ratio', median(vol_ratio) FROM ev WHERE label = 'CHURN' AND post_total_secs > 0""")
def engaged_churn_medians(inp):
    return A.engaged_churn_medians(labelled_events(inp)).withColumnRenamed("column", "column_name")


@query("engaged_churn_would_be", "would_be n:i share:f", """
SELECT would_be, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM (
  SELECT CASE WHEN vol_ratio < 0.5 THEN 'CONTRACTION' WHEN vol_ratio > 1.5 THEN 'EXPANSION' ELSE 'STABLE' END AS would_be
  FROM ev WHERE label = 'CHURN' AND post_total_secs > 0 AND vol_ratio IS NOT NULL) GROUP BY 1""")
def engaged_churn_would_be(inp):
    return A.engaged_churn_would_be(labelled_events(inp), inp.cfg)


def _extensions_sql(hi: str) -> str:
    return f"""
SELECT msno, E, last_pre_txn_date, transaction_date, membership_expire_date, actual_amount_paid, payment_plan_days,
  date_diff('day', transaction_date, E) AS days_before_E, date_diff('day', E, membership_expire_date) AS extension_days
FROM (SELECT e.msno, e.E, e.last_pre_txn_date, t.*EXCLUDE (msno), row_number() OVER (PARTITION BY e.msno, e.E
    ORDER BY t.transaction_date, t.membership_expire_date, t.actual_amount_paid, t.plan_list_price,
      t.payment_plan_days, t.payment_method_id, t.is_auto_renew) AS rn
  FROM ev e JOIN txn t ON t.msno = e.msno AND t.transaction_date BETWEEN e.last_pre_txn_date AND {hi}
    AND t.membership_expire_date > e.E AND t.actual_amount_paid > 0 AND t.is_cancel = 0
  WHERE e.label = 'CHURN' AND e.post_total_secs > 0) WHERE rn = 1"""


_EXTENSION = ("msno E:d last_pre_txn_date:d transaction_date:d membership_expire_date:d actual_amount_paid:i "
              "payment_plan_days:i days_before_E:i extension_days:i")


@query("missed_early_renewals", _EXTENSION, _extensions_sql("e.E - 1"))
def missed_early_renewals(inp):
    # Empty when the early-renewal rule works: the audit must find nothing it missed.
    events, txn, _ = _all(inp)
    return A.missed_early_renewals(events, txn)


def _forward_only(inp):
    """Labels under the forward rule alone, where early renewals do get missed."""
    from renewscope.operators.cohort import expiry_events
    from renewscope.operators.labels import with_label
    from renewscope.operators.renewal import renewal_signals
    from renewscope.operators.usage import cohort_usage, usage_days, usage_near, usage_windows

    txn = distinct_transactions(inp.transactions)
    days = transaction_days(txn)
    cohort = expiry_events(txn, inp.cfg)
    events = renewal_signals(cohort, days, inp.cfg).withColumn("renewed", F.col("renewed_forward"))
    usage = cohort_usage(usage_days(usage_near(inp.usage, inp.cfg, None, inp.cfg.window_days), inp.cfg), cohort)
    return with_label(usage_windows(events, usage, inp.cfg), inp.cfg), txn


_FORWARD = "SELECT * FROM renewal r JOIN usage u USING (msno, E) WHERE pre_n_days >= 3 AND renewed_forward = 0 AND post_total_secs > 0"


def _forward_sql(hi: str) -> str:
    return _extensions_sql(hi).replace("FROM ev e", f"FROM ({_FORWARD}) e").replace(
        "WHERE e.label = 'CHURN' AND e.post_total_secs > 0", "")


@query("missed_early_renewals_forward_rule", _EXTENSION, _forward_sql("e.E - 1"))
def missed_early_renewals_forward_rule(inp):
    return A.missed_early_renewals(*_forward_only(inp))


@query("broad_missed_renewals", _EXTENSION, _forward_sql("e.E + 30"))
def broad_missed_renewals(inp):
    events, txn = _forward_only(inp)
    return A.broad_missed_renewals(events, txn, inp.cfg)


@query("broad_missed_renewal_timing", "timing n:i",
       "SELECT CASE WHEN transaction_date < E THEN 'posted before E' ELSE 'posted on/after E' END AS timing, "
       f"count(*) AS n FROM ({_forward_sql('e.E + 30')}) GROUP BY 1")
def broad_missed_renewal_timing(inp):
    return A.posting_timing(broad_missed_renewals(inp))


def _late_sql(days: int) -> str:
    return f"""
SELECT e.msno, e.E, e.expiry_month, e.label, e.renewed, date_diff('day', e.E, f.transaction_date) AS first_paid_day,
  f.membership_expire_date > e.E AS first_extends,
  e.E + {days} <= (SELECT max(transaction_date) FROM txn) AS observable
FROM ev e LEFT JOIN (SELECT * FROM (SELECT c.msno, c.E, t.*EXCLUDE (msno), row_number() OVER (PARTITION BY c.msno, c.E
    ORDER BY t.transaction_date, t.membership_expire_date) AS rn
  FROM cohort c JOIN txn t ON t.msno = c.msno AND t.transaction_date BETWEEN c.E AND c.E + {days}
    AND t.actual_amount_paid > 0 AND t.is_cancel = 0) WHERE rn = 1) f USING (msno, E)"""


def _late(inp):
    events, txn, days = _all(inp)
    return A.late_window(events, txn, days, inp.cfg)


@query("first_paid_renewal_within_60_days", "msno E:d label first_paid_day:f extends:f observable:i",
       f"SELECT *, CAST(first_extends AS INT) AS extends FROM ({_late_sql(60)})")
def first_paid_renewal_within_60_days(inp):
    return _late(inp).withColumn("extends", F.col("first_extends").cast("int"))


@query("late_renewal_summary", "n_churn:i n_observable:i n_late:i n_late_extends:i", f"""
SELECT count(*) FILTER (WHERE label = 'CHURN') AS n_churn,
  count(*) FILTER (WHERE label = 'CHURN' AND observable) AS n_observable,
  count(*) FILTER (WHERE label = 'CHURN' AND observable AND first_paid_day IS NOT NULL) AS n_late,
  count(*) FILTER (WHERE label = 'CHURN' AND observable AND first_extends) AS n_late_extends
FROM ({_late_sql(60)})""")
def late_renewal_summary(inp):
    return A.late_renewal_summary(_late(inp))


@query("late_renewal_day_bins", "bin n:i", f"""
SELECT * FROM (SELECT CASE WHEN d > 30 AND d <= 35 THEN '(30, 35]' WHEN d > 35 AND d <= 40 THEN '(35, 40]'
    WHEN d > 40 AND d <= 45 THEN '(40, 45]' WHEN d > 45 AND d <= 50 THEN '(45, 50]'
    WHEN d > 50 AND d <= 60 THEN '(50, 60]' END AS bin, count(*) AS n
  FROM (SELECT first_paid_day AS d FROM ({_late_sql(60)}) WHERE label = 'CHURN' AND observable) GROUP BY 1)
WHERE bin IS NOT NULL""")
def late_renewal_day_bins(inp):
    return A.late_renewal_bins(_late(inp), inp.cfg.late_grid)


@query("renewal_rate_by_grace", "threshold:i rate:f", " UNION ALL ".join(
    f"SELECT {g} AS threshold, avg(CASE WHEN first_paid_day <= {g} THEN 1 ELSE 0 END) AS rate "
    f"FROM ({_late_sql(60)}) WHERE observable" for g in (30, 35, 40, 45, 50, 60)))
def renewal_rate_by_grace(inp):
    from renewscope.operators.explore import rate_by_threshold

    return rate_by_threshold(_late(inp).where("observable"), "first_paid_day", inp.cfg.late_grid)


@query("late_renewal_by_month", "expiry_month late_pct:f",
       "SELECT expiry_month, avg(CAST(first_paid_day IS NOT NULL AS INT)) * 100 AS late_pct "
       f"FROM ({_late_sql(60)}) WHERE label = 'CHURN' AND observable GROUP BY 1")
def late_renewal_by_month(inp):
    return A.late_renewal_by_month(_late(inp))


def _official_sql(h0, h1, e0, e1) -> str:
    return f"""
SELECT c.msno, c.last_expire, date_diff('day', r.first_ren, least(c.last_expire, k.cancel_min)) * -1 AS gap,
  CASE WHEN r.first_ren IS NULL OR date_diff('day', least(c.last_expire, k.cancel_min), r.first_ren) >= 30
    THEN 1 ELSE 0 END AS pred_churn
FROM (SELECT msno, membership_expire_date AS last_expire FROM (SELECT *, row_number() OVER (PARTITION BY msno
    ORDER BY transaction_date DESC, is_cancel DESC, membership_expire_date DESC) AS rn
  FROM txn WHERE transaction_date BETWEEN DATE '{h0}' AND DATE '{h1}') WHERE rn = 1
    AND membership_expire_date BETWEEN DATE '{e0}' AND DATE '{e1}') c
LEFT JOIN (SELECT msno, min(transaction_date) AS first_ren FROM txn WHERE is_cancel = 0
  AND transaction_date > DATE '{h1}' GROUP BY 1) r USING (msno)
LEFT JOIN (SELECT t.msno, min(t.membership_expire_date) AS cancel_min FROM txn t JOIN (SELECT msno,
    min(transaction_date) AS first_ren FROM txn WHERE is_cancel = 0 AND transaction_date > DATE '{h1}' GROUP BY 1) f
  USING (msno) WHERE t.is_cancel = 1 AND t.transaction_date > DATE '{h1}' AND t.transaction_date < f.first_ren
  GROUP BY 1) k USING (msno)"""


_HIST, _EXPIRE = ("1998-01-01", "1998-06-30"), ("1998-07-01", "1999-06-30")


def _official(inp):
    return A.official_churn(distinct_transactions(inp.transactions), _HIST, _EXPIRE)


def _truth(inp):
    """A second opinion on churn per user: the label of the user's last expiry event."""
    last = F.max(F.struct("E", "renewed")).alias("t")
    return labelled_events(inp).groupBy("msno").agg(last).select(
        "msno", (1 - F.col("t.renewed")).alias("is_churn"))


_TRUTH_SQL = "SELECT msno, 1 - arg_max(renewed, E) AS is_churn FROM ev GROUP BY 1"


@query("official_churn_labels", "msno last_expire:d gap:f pred_churn:i", _official_sql(*_HIST, *_EXPIRE))
def official_churn_labels(inp):
    return _official(inp)


@query("label_agreement", "n_truth:i n_matched:i coverage:f accuracy:f truth_rate:f", f"""
SELECT count(*) AS n_truth, count(p.msno) AS n_matched, count(p.msno) / count(*) AS coverage,
  avg(CASE WHEN p.msno IS NOT NULL THEN CAST(is_churn = pred_churn AS INT) END) AS accuracy,
  avg(is_churn) AS truth_rate
FROM ({_TRUTH_SQL}) t LEFT JOIN ({_official_sql(*_HIST, *_EXPIRE)}) p USING (msno)""")
def label_agreement(inp):
    return A.label_agreement(_truth(inp), _official(inp))


@query("label_agreement_table", "is_churn:i pred_churn:i n:i",
       f"SELECT is_churn, pred_churn, count(*) AS n FROM ({_TRUTH_SQL}) t "
       f"JOIN ({_official_sql(*_HIST, *_EXPIRE)}) p USING (msno) GROUP BY 1, 2")
def label_agreement_table(inp):
    return A.agreement_table(_truth(inp), _official(inp))


_ROBUST = """
SELECT e.msno, e.E, e.expiry_month, max(t.membership_expire_date) FILTER (WHERE t.transaction_date <= e.E) AS cover_end,
  coalesce(CAST(max(t.membership_expire_date) FILTER (WHERE t.transaction_date <= e.E) > e.E AS INT), 0) AS pushback,
  date_diff('day', e.E, max(t.membership_expire_date) FILTER (WHERE t.transaction_date <= e.E)) AS days_past,
  CAST(count(t.msno) FILTER (WHERE t.transaction_date > e.E AND t.transaction_date <= e.E + 30) > 0 AS INT) AS forward
FROM ev e LEFT JOIN txn t ON t.msno = e.msno AND t.is_cancel = 0 WHERE e.label = 'CHURN' GROUP BY 1, 2, 3"""


def _robust(inp):
    events, _, days = _all(inp)
    return A.churn_robustness(events, days)


@query("churn_robustness", "msno E:d cover_end:d pushback:i days_past:f forward:i", _ROBUST)
def churn_robustness(inp):
    return _robust(inp)


@query("churn_robustness_summary", "n_churn:i n_pushback:i n_forward:i n_either:i n_survive:i", f"""
SELECT count(*) AS n_churn, sum(pushback) AS n_pushback, sum(forward) AS n_forward,
  sum(greatest(pushback, forward)) AS n_either, count(*) - sum(greatest(pushback, forward)) AS n_survive
FROM ({_ROBUST})""")
def churn_robustness_summary(inp):
    return A.robustness_summary(_robust(inp))


@query("churn_robustness_by_month", "expiry_month pushback_pct:f n:i",
       f"SELECT expiry_month, avg(pushback) * 100 AS pushback_pct, count(*) AS n FROM ({_ROBUST}) GROUP BY 1")
def churn_robustness_by_month(inp):
    return A.robustness_by_month(_robust(inp))


@query("coverage_past_expiry_quantiles", "median:f p90:f longest:f", """
SELECT quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.9) AS p90, max(d) AS longest FROM (
  SELECT date_diff('day', E, pre_cov_end) AS d FROM renewal WHERE pre_cov_end IS NOT NULL)""")
def coverage_past_expiry_quantiles(inp):
    from renewscope.operators.cohort import expiry_events
    from renewscope.operators.renewal import renewal_signals

    txn = distinct_transactions(inp.transactions)
    signals = renewal_signals(expiry_events(txn, inp.cfg), transaction_days(txn), inp.cfg)
    past = signals.select(F.col("renewed_pre").alias("pushback"),
                          F.datediff("pre_cov_end", "E").alias("days_past"))
    return A.pushback_quantiles(past)


@query("next_event_label", "msno E:d label next_label",
       "SELECT msno, E, label, lead(label) OVER (PARTITION BY msno ORDER BY E) AS next_label FROM ev")
def next_event_label(inp):
    return A.next_labels(labelled_events(inp))


@query("state_transition_matrix", "label next_label n:i share:f", """
SELECT label, next_label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY label) AS share
FROM (SELECT label, lead(label) OVER (PARTITION BY msno ORDER BY E) AS next_label FROM ev)
WHERE next_label IS NOT NULL GROUP BY 1, 2""")
def state_transition_matrix(inp):
    return A.transition_matrix(labelled_events(inp))
