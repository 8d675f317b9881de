"""Renewal decision for each expiry event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewscope.config import StudyConfig
from renewscope.operators.timeline import along_timeline, window_total


def renewal_signals(events: DataFrame, txn_days: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Events with both renewal routes: a paid transaction in [E, E + grace], or an
    earlier non-cancel transaction whose coverage reaches past E."""

    def measures(frame):
        first = F.first(
            F.when(F.col("d_first_paid").isNotNull(), F.struct("_day", "d_first_paid")),
            ignorenulls=True,
        ).over(frame(0, cfg.grace_days))
        return {
            "n_grace_txns": window_total("d_txns", frame, 0, cfg.grace_days),
            "_n_paid": window_total("d_paid", frame, 0, cfg.grace_days),
            "_first": first,
            "cover_end": F.max("d_cover_end").over(frame(None, 0)),
        }

    seen = along_timeline(events, txn_days, measures)
    first_paid = F.col("_first.d_first_paid")
    covered = F.coalesce(F.col("cover_end") > F.col("E"), F.lit(False))
    return (
        seen.withColumn("grace_end", F.date_add("E", cfg.grace_days))
        .withColumn("n_grace_txns", F.col("n_grace_txns").cast("int"))
        .withColumn("renewed_forward", (F.col("_n_paid") > 0).cast("int"))
        .withColumn("renewed_pre", covered.cast("int"))
        .withColumn("pre_cov_end", F.when(covered, F.col("cover_end")))
        .withColumn("renewed", F.greatest("renewed_forward", "renewed_pre"))
        .withColumn("first_renewal_date",
                    F.date_add(F.lit("1970-01-01").cast("date"), F.col("_first._day")))
        .withColumn("post_list_price", first_paid["plan_list_price"])
        .withColumn("post_amount_paid", first_paid["actual_amount_paid"])
        .drop("_n_paid", "_first", "cover_end")
    )


def with_renewal(events: DataFrame, txn_days: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Events with the final decision only; the two routes are dropped."""
    return renewal_signals(events, txn_days, cfg).drop("renewed_forward", "renewed_pre", "pre_cov_end")
