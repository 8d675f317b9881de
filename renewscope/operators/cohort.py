"""Transactions and the cohort of expiry events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewscope.config import StudyConfig
from renewscope.functions.scalar import month_label, paid_renewal
from renewscope.sources.schemas import TXN_TIE_ORDER


def distinct_transactions(*parts: DataFrame) -> DataFrame:
    """Union of all transaction files without exact duplicates.

    The columns are put in one order first, so files may differ in column order.
    """
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()


def expiry_events(txn: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row per (msno, E): the last transaction known at E that carries expiry E.

    The last row is the greatest by transaction date, then by the remaining columns,
    so the choice does not depend on file order. The maximum is taken partially on
    the map side; a hot (msno, E) costs one row per task in the shuffle.
    """
    expire, made = F.col("membership_expire_date"), F.col("transaction_date")
    known = txn.where(expire.between(F.lit(cfg.cohort_start).cast("date"),
                                     F.lit(cfg.cohort_end).cast("date")) & (made <= expire))
    last = F.max(F.struct("transaction_date", *TXN_TIE_ORDER)).alias("t")
    return (
        known.groupBy("msno", expire.alias("E")).agg(last)
        .select(
            "msno", "E", month_label(F.col("E")).alias("expiry_month"),
            F.col("t.transaction_date").alias("last_pre_txn_date"),
            F.col("t.plan_list_price").alias("pre_list_price"),
            F.col("t.actual_amount_paid").alias("pre_amount_paid"),
            "t.payment_plan_days", "t.payment_method_id", "t.is_auto_renew", "t.is_cancel",
        )
    )


def transaction_days(txn: DataFrame) -> DataFrame:
    """Transactions reduced to one row per user and day.

    Keeps everything that later aggregates need, apart from medians and modes.
    """
    made = F.col("transaction_date")
    paid = paid_renewal(F.col("actual_amount_paid"), F.col("is_cancel"))
    covering = F.col("is_cancel") == 0
    offer = F.struct("membership_expire_date", *TXN_TIE_ORDER)
    return txn.groupBy("msno", made.alias("date")).agg(
        F.count(F.lit(1)).alias("d_txns"),
        F.sum(paid.cast("long")).alias("d_paid"),
        F.sum(F.col("is_cancel").cast("long")).alias("d_cancels"),
        F.sum(F.col("is_auto_renew").cast("long")).alias("d_autorenew"),
        F.sum(F.col("plan_list_price").cast("long")).alias("d_price"),
        F.count("plan_list_price").alias("d_priced"),
        F.max(F.when(covering, F.col("membership_expire_date"))).alias("d_cover_end"),
        F.min(F.when(paid == 1, offer)).alias("d_first_paid"),
        F.max(offer).alias("d_last"),
    )
