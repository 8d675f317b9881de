"""The engineered event table: every feature, target and split column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewscope.operators.cohort import distinct_transactions, expiry_events, transaction_days
from renewscope.operators.cutoff import cutoff_matrix
from renewscope.operators.history import with_history
from renewscope.operators.labels import with_label
from renewscope.operators.members import with_demographics
from renewscope.operators.renewal import with_renewal
from renewscope.operators.splits import with_fixed_split
from renewscope.operators.usage import cohort_usage, usage_days, usage_near, usage_windows
from renewscope.session import through_table
from renewscope.sources.adapters import StudyInputs

_HISTORY = (
    "n_hist_txns", "mean_hist_price", "median_hist_paid", "cancel_rate", "auto_renew_rate",
    "mode_pay_method", "tenure_days", "recency_days", "has_hist_txn",
    "n_prior_renewals", "n_prior_cancels", "n_prior_autorenew", "prior_renewal_rate",
)


def event_history(inputs: StudyInputs) -> DataFrame:
    """(msno, E) with the transaction history strictly before E."""
    txn = distinct_transactions(inputs.transactions)
    points = expiry_events(txn, inputs.cfg).select("msno", "E")
    return with_history(points, txn, transaction_days(txn), at="E").select("msno", "E", *_HISTORY)


def _labelled_with_members(inputs: StudyInputs, txn: DataFrame, txn_days: DataFrame) -> DataFrame:
    cohort = expiry_events(txn, inputs.cfg)
    days = cohort_usage(usage_days(usage_near(inputs.usage, inputs.cfg, None, inputs.cfg.window_days), inputs.cfg), cohort)
    renewed = with_renewal(cohort, txn_days, inputs.cfg)
    events = with_label(usage_windows(renewed, days, inputs.cfg), inputs.cfg)
    if inputs.members is not None:
        events = with_demographics(events, inputs.members, inputs.cfg)
    return with_fixed_split(events, inputs.cfg)


def engineered_events(inputs: StudyInputs) -> DataFrame:
    txn = distinct_transactions(inputs.transactions)
    txn_days = transaction_days(txn)
    events = _labelled_with_members(inputs, txn, txn_days)
    points = expiry_events(txn, inputs.cfg).select("msno", "E")
    history = with_history(points, txn, txn_days, at="E").select("msno", "E", *_HISTORY)
    return events.join(history, ["msno", "E"])


def rebuilt_at_cutoffs(inputs: StudyInputs, mode: str = "uniform") -> DataFrame:
    """Base features of the modellable events at every cutoff, in one job. Histories are
    built at the decision dates only; c = 0 is one of them."""
    txn = distinct_transactions(inputs.transactions)
    txn_days = transaction_days(txn)
    events = _labelled_with_members(inputs, txn, txn_days).where(F.col("is_modellable") == 1)
    carried = ["expiry_month", "label", "renewed", "vol_ratio", "user_fold", "is_holdout",
               "month_idx", "is_modellable"]
    if inputs.members is not None:
        carried += ["city", "bd", "gender", "registered_via", "registration_init_time"]
    # Read twice, for its dates and its features: written once.
    events = through_table(events, "modellable")
    return cutoff_matrix(events, txn, txn_days, inputs.cfg, carried, mode)
