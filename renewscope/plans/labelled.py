"""From raw inputs to labelled expiry events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from renewscope.operators.cohort import distinct_transactions, expiry_events, transaction_days
from renewscope.operators.labels import with_label
from renewscope.operators.renewal import with_renewal
from renewscope.operators.usage import cohort_usage, usage_days, usage_near, usage_windows
from renewscope.sources.adapters import StudyInputs


def labelled_events(inputs: StudyInputs) -> DataFrame:
    """Cohort, renewal decision, usage totals and label: one lazy plan."""
    txn = distinct_transactions(inputs.transactions)
    cohort = expiry_events(txn, inputs.cfg)
    renewed = with_renewal(cohort, transaction_days(txn), inputs.cfg)
    days = cohort_usage(usage_days(usage_near(inputs.usage, inputs.cfg, None, inputs.cfg.window_days), inputs.cfg), cohort)
    return with_label(usage_windows(renewed, days, inputs.cfg), inputs.cfg)
