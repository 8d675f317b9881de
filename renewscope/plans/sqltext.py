"""Plain SQL for the same results, used to check the Spark plans.

Common table expressions are written once per study and a query takes along only
the ones it mentions.
"""

from __future__ import annotations

import re

from renewscope.config import StudyConfig


def compose(ctes: dict[str, str], body: str) -> str:
    """Body preceded by the expressions it needs, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in ctes:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(ctes[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in needed) + "\n" + body


_ORDERS = {
    "txn": """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS msno,
  CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS payment_method_id,
  CAST([30, 90, 180, 365][CAST(o_orderkey % 4 AS INT) + 1] AS BIGINT) AS payment_plan_days,
  CAST(round(o_totalprice) AS BIGINT) AS plan_list_price,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(round(o_totalprice) AS BIGINT) END AS actual_amount_paid,
  CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS BIGINT) AS is_auto_renew,
  CAST(o_orderdate AS DATE) AS transaction_date,
  CAST(o_orderdate AS DATE) + CAST([30, 90, 180, 365][CAST(o_orderkey % 4 AS INT) + 1] AS INT) AS membership_expire_date,
  CAST(o_orderstatus = 'F' AND o_orderkey % 5 = 0 AS BIGINT) AS is_cancel
FROM orders""",
    "logs": """
SELECT CAST(o_custkey AS VARCHAR) AS msno, CAST(l_shipdate AS DATE) AS date,
  least(greatest(sum(l_quantity * 3600), 0), 86400) AS total_secs,
  count(*) FILTER (WHERE l_returnflag = 'A') AS num_25,
  count(*) FILTER (WHERE l_returnflag = 'N') AS num_100,
  count(DISTINCT l_partkey) AS num_unq
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "members": """
SELECT CAST(c_custkey AS VARCHAR) AS msno, CAST(c_nationkey AS BIGINT) AS city,
  CASE WHEN floor(c_acctbal / 100) BETWEEN 10 AND 90 THEN CAST(floor(c_acctbal / 100) AS BIGINT) END AS bd,
  c_mktsegment AS gender, c_custkey % 7 AS registered_via,
  CAST(try_strptime(CAST(19900101 + (c_custkey % 14) * 100 + c_custkey % 28 AS VARCHAR), '%Y%m%d') AS DATE)
    AS registration_init_time
FROM customer""",
}

_EVENTS = {
    "txn": """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS msno,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS payment_method_id,
  3 + event_id % 5 AS payment_plan_days,
  CAST(round(value * 100) AS BIGINT) AS plan_list_price,
  CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS actual_amount_paid,
  CAST(event_id % 3 = 0 AS BIGINT) AS is_auto_renew,
  CAST(ts AS DATE) AS transaction_date,
  CAST(ts AS DATE) + CAST(3 + event_id % 5 AS INT) AS membership_expire_date,
  CAST(event_type = 'error' AS BIGINT) AS is_cancel
FROM events WHERE event_type IN ('purchase', 'error')""",
    "logs": """
SELECT CAST(user_id AS VARCHAR) AS msno, CAST(ts AS DATE) AS date,
  least(greatest(sum(value * 120), 0), 86400) AS total_secs,
  count(*) FILTER (WHERE event_type = 'view') AS num_25,
  count(*) FILTER (WHERE event_type = 'click') AS num_100,
  count(DISTINCT props) AS num_unq
FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2""",
}


def study_ctes(cfg: StudyConfig, source: str) -> dict[str, str]:
    raw = dict(_ORDERS if source == "orders" else _EVENTS)
    w, ob, g = cfg.window_days, cfg.obs_len, cfg.grace_days
    off = "date_diff('day', E, date)"
    horizon = ",\n  ".join(
        f"coalesce(sum(total_secs) FILTER (WHERE off BETWEEN {-(h + ob)} AND {-(h + 1)}), 0) AS h{h}_secs, "
        f"count(date) FILTER (WHERE off BETWEEN {-(h + ob)} AND {-(h + 1)}) AS h{h}_ndays"
        for h in cfg.horizons)
    recent = ",\n  ".join(
        f"coalesce(sum(total_secs) FILTER (WHERE off BETWEEN {-c} AND -1), 0) AS recent_secs_{c}, "
        f"count(date) FILTER (WHERE off BETWEEN {-c} AND -1) AS recent_ndays_{c}"
        for c in cfg.cutoffs if c)
    rates = ",\n  ".join(
        f"CASE WHEN h{h}_ndays > 0 THEN h{h}_secs / h{h}_ndays END AS h{h}_rate, "
        f"h{h}_ndays / {float(ob)} AS h{h}_active" for h in cfg.horizons)
    raw |= {
        "cohort": f"""
SELECT msno, membership_expire_date AS E, strftime(membership_expire_date, '%Y-%m') AS expiry_month,
  transaction_date AS last_pre_txn_date, plan_list_price AS pre_list_price,
  actual_amount_paid AS pre_amount_paid, payment_plan_days, payment_method_id, is_auto_renew, is_cancel
FROM (SELECT *, row_number() OVER (PARTITION BY msno, membership_expire_date ORDER BY transaction_date DESC,
    actual_amount_paid DESC, plan_list_price DESC, is_cancel DESC, is_auto_renew DESC,
    payment_plan_days DESC, payment_method_id DESC) AS rn
  FROM txn WHERE membership_expire_date BETWEEN DATE '{cfg.cohort_start}' AND DATE '{cfg.cohort_end}'
    AND transaction_date <= membership_expire_date) WHERE rn = 1""",
        "grace": f"""
SELECT c.msno, c.E, t.*EXCLUDE (msno),
  CAST(t.actual_amount_paid > 0 AND t.is_cancel = 0 AS INT) AS paid
FROM cohort c JOIN txn t ON t.msno = c.msno AND t.transaction_date BETWEEN c.E AND c.E + {g}""",
        "grace_agg": "SELECT msno, E, count(*) AS n_grace_txns, max(paid) AS fwd FROM grace GROUP BY 1, 2",
        "first_paid": """
SELECT msno, E, transaction_date AS first_renewal_date, plan_list_price AS post_list_price,
  actual_amount_paid AS post_amount_paid
FROM (SELECT *, row_number() OVER (PARTITION BY msno, E ORDER BY transaction_date, membership_expire_date,
    actual_amount_paid, plan_list_price, is_cancel, is_auto_renew, payment_plan_days, payment_method_id) AS rn
  FROM grace WHERE paid = 1) WHERE rn = 1""",
        "early": """
SELECT c.msno, c.E, max(t.membership_expire_date) AS pre_cov_end
FROM cohort c JOIN txn t ON t.msno = c.msno AND t.is_cancel = 0 AND t.transaction_date <= c.E
  AND t.membership_expire_date > c.E GROUP BY 1, 2""",
        "renewal": f"""
SELECT c.*, c.E + {g} AS grace_end, coalesce(a.n_grace_txns, 0) AS n_grace_txns,
  coalesce(a.fwd, 0) AS renewed_forward, CAST(y.pre_cov_end IS NOT NULL AS INT) AS renewed_pre, y.pre_cov_end,
  greatest(coalesce(a.fwd, 0), CAST(y.pre_cov_end IS NOT NULL AS INT)) AS renewed,
  f.first_renewal_date, f.post_list_price, f.post_amount_paid
FROM cohort c LEFT JOIN grace_agg a USING (msno, E) LEFT JOIN first_paid f USING (msno, E)
  LEFT JOIN early y USING (msno, E)""",
        "fanned": f"SELECT c.msno, c.E, l.*EXCLUDE (msno), {off} AS off FROM cohort c JOIN logs l ON l.msno = c.msno",
        "sums": f"""
SELECT c.msno, c.E,
  coalesce(sum(total_secs) FILTER (WHERE off BETWEEN {-w} AND -1), 0) AS pre_total_secs,
  count(DISTINCT date) FILTER (WHERE off BETWEEN {-w} AND -1) AS pre_n_days,
  coalesce(sum(total_secs) FILTER (WHERE off BETWEEN 1 AND {w}), 0) AS post_total_secs,
  count(DISTINCT date) FILTER (WHERE off BETWEEN 1 AND {w}) AS post_n_days,
  coalesce(sum(total_secs) FILTER (WHERE off <= -1), 0) AS obs_secs_full,
  count(date) FILTER (WHERE off <= -1) AS obs_ndays_full,
  {horizon}{"," if recent else ""}
  {recent}
FROM cohort c LEFT JOIN fanned f ON f.msno = c.msno AND f.E = c.E GROUP BY 1, 2""",
        "usage": f"""
SELECT *, CASE WHEN pre_n_days > 0 THEN pre_total_secs / pre_n_days END AS pre_rate,
  CASE WHEN post_n_days > 0 THEN post_total_secs / post_n_days END AS post_rate,
  CASE WHEN pre_total_secs > 0 THEN post_total_secs / pre_total_secs END AS vol_ratio,
  CASE WHEN obs_ndays_full > 0 THEN obs_secs_full / obs_ndays_full END AS obs_secs_per_active_day,
  {rates}
FROM sums""",
        "ev": f"""
SELECT r.*, u.*EXCLUDE (msno, E),
  CASE WHEN obs_secs_per_active_day > 0 THEN pre_rate / obs_secs_per_active_day END AS recent_vs_life_ratio,
  CASE WHEN pre_n_days < {cfg.min_days} THEN 'INSUFFICIENT_DATA' WHEN renewed = 0 THEN 'CHURN'
    WHEN post_total_secs = 0 THEN 'CONTRACTION' WHEN vol_ratio IS NULL THEN 'INSUFFICIENT_DATA'
    WHEN vol_ratio < {cfg.vol_low} THEN 'CONTRACTION' WHEN vol_ratio > {cfg.vol_high} THEN 'EXPANSION'
    ELSE 'STABLE' END AS label,
  CAST(renewed = 1 AND post_total_secs = 0 AS INT) AS is_silent_renewer,
  CAST(pre_n_days >= {cfg.min_days} AS INT) AS has_pre_evidence,
  CAST(post_n_days >= {cfg.min_days} AS INT) AS has_post_evidence,
  CAST(pre_n_days >= {cfg.min_days} AND post_n_days >= {cfg.min_days} AS INT) AS has_evidence,
  CAST(post_n_days >= {cfg.min_days} AND post_total_secs = 0 AS INT) AS post_observed_but_silent
FROM renewal r JOIN usage u USING (msno, E)""",
        "core": "SELECT * FROM ev WHERE label <> 'INSUFFICIENT_DATA'",
        "decisions": "SELECT msno, E, cutoff_days, E - CAST(cutoff_days AS INT) AS dec FROM cohort, "
                     f"(SELECT unnest({list(cfg.cutoffs)}) AS cutoff_days)",
        "hist": """
SELECT d.msno, d.E, d.cutoff_days, count(*) AS n_hist_txns, min(transaction_date) AS first_date,
  max(transaction_date) AS last_date, avg(plan_list_price) AS mean_hist_price,
  median(actual_amount_paid) AS median_hist_paid, avg(is_cancel) AS cancel_rate,
  avg(is_auto_renew) AS auto_renew_rate, CAST(sum(is_cancel) AS BIGINT) AS n_prior_cancels,
  CAST(sum(is_auto_renew) AS BIGINT) AS n_prior_autorenew,
  CAST(sum(CAST(actual_amount_paid > 0 AND is_cancel = 0 AS INT)) AS BIGINT) AS n_prior_renewals
FROM decisions d JOIN txn t ON t.msno = d.msno AND t.transaction_date < d.dec GROUP BY 1, 2, 3""",
        "method_mode": """
SELECT msno, E, cutoff_days, payment_method_id AS mode_pay_method FROM (
  SELECT d.msno, d.E, d.cutoff_days, t.payment_method_id,
    row_number() OVER (PARTITION BY d.msno, d.E, d.cutoff_days ORDER BY count(*) DESC, t.payment_method_id) AS rn
  FROM decisions d JOIN txn t ON t.msno = d.msno AND t.transaction_date < d.dec GROUP BY 1, 2, 3, 4)
WHERE rn = 1""",
        "as_of": """
SELECT * FROM (SELECT d.msno, d.E, d.cutoff_days, t.*EXCLUDE (msno), row_number() OVER (
    PARTITION BY d.msno, d.E, d.cutoff_days ORDER BY transaction_date DESC, membership_expire_date DESC,
      actual_amount_paid DESC, plan_list_price DESC, is_cancel DESC, is_auto_renew DESC, payment_plan_days DESC,
      payment_method_id DESC) AS rn
  FROM decisions d JOIN txn t ON t.msno = d.msno AND t.transaction_date <= d.dec) WHERE rn = 1""",
        "at_cutoff": """
SELECT d.msno, d.E, d.cutoff_days, a.plan_list_price AS pre_list_price, a.actual_amount_paid AS pre_amount_paid,
  a.payment_plan_days, a.payment_method_id, a.is_auto_renew, a.is_cancel,
  h.n_hist_txns, h.mean_hist_price, h.median_hist_paid, h.cancel_rate, h.auto_renew_rate, m.mode_pay_method,
  date_diff('day', h.first_date, d.dec) AS tenure_days, date_diff('day', h.last_date, d.dec) AS recency_days,
  CAST(h.n_hist_txns IS NOT NULL AS INT) AS has_hist_txn,
  coalesce(h.n_prior_renewals, 0) AS n_prior_renewals, coalesce(h.n_prior_cancels, 0) AS n_prior_cancels,
  coalesce(h.n_prior_autorenew, 0) AS n_prior_autorenew,
  coalesce(h.n_prior_renewals / h.n_hist_txns, 0) AS prior_renewal_rate
FROM decisions d LEFT JOIN as_of a USING (msno, E, cutoff_days) LEFT JOIN hist h USING (msno, E, cutoff_days)
  LEFT JOIN method_mode m USING (msno, E, cutoff_days)""",
    }
    return raw


def md5_mod_sql(text: str, m: int) -> str:
    """Folds the digest in 32-bit blocks, as the Spark expression does."""
    shift = pow(2, 32, m)
    acc = "0"
    for start in (1, 9, 17, 25):
        acc = f"(({acc}) * {shift} + ('0x' || substr(md5({text}), {start}, 8))::BIGINT) % {m}"
    return f"({acc})"
