"""Checks of the label: sensitivity, alternatives and missed renewals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from renewscope.config import CLASS_ORDER, StudyConfig
from renewscope.functions.scalar import flag, movement_class, paid_renewal, safe_ratio
from renewscope.operators.explore import counts_by, crosstab_shares, literal_table, right_closed_bin
from renewscope.operators.labels import core
from renewscope.operators.quantiles import exact_quantiles, quantile_columns
from renewscope.operators.ranges import binned_interval_join
from renewscope.operators.timeline import along_timeline, window_total


def _is_core() -> Column:
    return F.col("label") != "INSUFFICIENT_DATA"


def class_distribution(events: DataFrame) -> DataFrame:
    """Share of each class among all events and among core events, absent classes 0."""
    classes = literal_table(events, "label", CLASS_ORDER)
    n = counts_by(events, "label")
    whole = W.partitionBy(F.lit(0))
    return (
        classes.join(n, "label", "left").fillna(0, ["n"])
        .withColumn("all_share", F.col("n") / F.sum("n").over(whole))
        .withColumn("core_share", F.when(_is_core(), F.col("n")).otherwise(0)
                    / F.sum(F.when(_is_core(), F.col("n"))).over(whole))
    )


def monthly_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("expiry_month").agg(
        F.count(F.lit(1)).alias("events"),
        F.avg("renewed").alias("renewal_rate"),
        F.avg("pre_rate").alias("mean_pre_rate"),
        F.avg("post_rate").alias("mean_post_rate"),
        F.avg(_is_core().cast("int")).alias("core_rate"),
    )


def monthly_class_mix(events: DataFrame) -> DataFrame:
    return crosstab_shares(core(events), "expiry_month", "label")


def quality_audit(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """(metric, n, pct): eleven conditional counts in one aggregate."""
    conditions = {
        "total_events": F.lit(True),
        "any_pre_day": F.col("pre_n_days") > 0,
        "pre_evidence": F.col("pre_n_days") >= cfg.min_days,
        "any_post_day": F.col("post_n_days") > 0,
        "post_evidence": F.col("post_n_days") >= cfg.min_days,
        "both_evidence": F.col("has_evidence") == 1,
        "renewed": F.col("renewed") == 1,
        "silent_renewer": F.col("is_silent_renewer") == 1,
        "post_observed_but_silent": F.col("post_observed_but_silent") == 1,
        "pre_zero_post_positive": (F.col("pre_rate") == 0) & (F.col("post_rate") > 0),
        "insufficient_data": ~_is_core(),
    }
    row = events.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
    total = row.withColumn("_total", F.col("total_events"))
    return total.unpivot(["_total"], list(conditions), "metric", "n").select(
        "metric", "n", F.bround(F.col("n") / F.col("_total") * 100, 2).alias("pct"))


def threshold_sweep(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Class shares, flip rate against the chosen band and stable share of the core,
    for bands 1 ± 0.20 … 1 ± 0.80 in steps of 0.05."""
    core_total = events.agg(F.count_if(_is_core())).scalar()
    movers = events.where((F.col("has_pre_evidence") == 1) & (F.col("renewed") == 1)
                          & F.col("vol_ratio").isNotNull())
    grid = F.explode(F.sequence(F.lit(20), F.lit(80), F.lit(5))).alias("pct")
    tau = F.col("pct") / 100.0
    ratio = F.col("vol_ratio")
    wide = movers.select("vol_ratio", grid).select(
        tau.alias("tau"),
        movement_class(ratio, 1 - tau, 1 + tau).alias("new"),
        movement_class(ratio, F.lit(cfg.vol_low), F.lit(cfg.vol_high)).alias("base"),
    )
    share = lambda name: F.avg((F.col("new") == name).cast("int"))
    return wide.groupBy("tau").agg(
        F.avg((F.col("new") != F.col("base")).cast("int")).alias("flip_rate"),
        (F.count_if(F.col("new") == "STABLE") / F.first(core_total)).alias("stable_of_core"),
        share("STABLE").alias("share_stable"),
        share("EXPANSION").alias("share_expansion"),
        share("CONTRACTION").alias("share_contraction"),
    )


def intensity_flips(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """(label, intensity_label, n, flipped): the label by volume against the label by
    seconds per active day."""
    movers = events.where(F.col("label").isin("CONTRACTION", "STABLE", "EXPANSION"))
    ratio = safe_ratio(F.col("post_rate"), F.col("pre_rate"))
    other = F.when(F.col("post_total_secs") == 0, F.lit("CONTRACTION")).otherwise(
        movement_class(ratio, cfg.vol_low, cfg.vol_high))
    return counts_by(movers.withColumn("intensity_label", other), "label", "intensity_label").withColumn(
        "flipped", (F.col("label") != F.col("intensity_label")).cast("int"))


def _sparse_post(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    return events.where((F.col("renewed") == 1) & (F.col("pre_n_days") >= cfg.min_days)
                        & (F.col("post_n_days") < cfg.min_days))


def sparse_post_summary(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Renewers with evidence before but little usage after the expiry."""
    kept = _sparse_post(events, cfg)
    median = exact_quantiles(kept, [], "vol_ratio", [0.5]).select("quantile").scalar()
    return kept.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("post_n_days") == 0).alias("n_zero"),
        F.count_if(F.col("post_n_days").between(1, cfg.min_days - 1)).alias("n_some"),
        F.avg((F.col("label") == "CONTRACTION").cast("int")).alias("contraction_share"),
    ).withColumn("median_ratio", median)


def sparse_post_labels(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    return counts_by(_sparse_post(events, cfg), "label")


def engaged_churn_summary(events: DataFrame) -> DataFrame:
    """Churners who go on listening: prevalence, volume held and cause signature."""
    churn = F.col("label") == "CHURN"
    active = churn & (F.col("post_total_secs") > 0)
    n_act, n_churn = F.count_if(active), F.count_if(churn)
    return events.agg(
        n_churn.alias("n_churn"), n_act.alias("n_active"),
        safe_ratio(n_act, n_churn).alias("active_of_churn"),
        safe_ratio(n_act, F.count(F.lit(1))).alias("active_of_all"),
        safe_ratio(n_act, F.count_if(_is_core())).alias("active_of_core"),
        safe_ratio(F.sum(F.when(active, F.col("post_total_secs"))), F.sum("post_total_secs"))
        .alias("volume_share"),
        F.avg(F.when(active, F.col("is_auto_renew"))).alias("auto_renew_rate"),
        F.avg(F.when(active, F.col("is_cancel"))).alias("cancel_rate"),
    )


def engaged_churn_medians(events: DataFrame) -> DataFrame:
    active = events.where((F.col("label") == "CHURN") & (F.col("post_total_secs") > 0))
    long = active.select(
        F.col("post_total_secs").alias("post_total_secs"),
        F.col("post_n_days").cast("double").alias("post_n_days"),
        F.col("vol_ratio").alias("vol_ratio"),
    ).unpivot([], ["post_total_secs", "post_n_days", "vol_ratio"], "column", "value")
    return exact_quantiles(long, ["column"], "value", [0.5]).select("column", F.col("quantile").alias("median"))


def engaged_churn_would_be(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The movement class listening churners would have had."""
    active = events.where((F.col("label") == "CHURN") & (F.col("post_total_secs") > 0)
                          & F.col("vol_ratio").isNotNull())
    would = active.withColumn("would_be", movement_class(F.col("vol_ratio"), cfg.vol_low, cfg.vol_high))
    return counts_by(would, "would_be").withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def active_churn(events: DataFrame) -> DataFrame:
    return events.where((F.col("label") == "CHURN") & (F.col("post_total_secs") > 0))


def paid_extensions(events: DataFrame, txn: DataFrame, hi: Column) -> DataFrame:
    """First paid transaction between the event's own transaction and `hi` that reaches
    past E, one row per active churn event.

    Repeated offers of a user and day are merged first and the pairs are found through
    day bins near each event's interval.
    """
    paid = (
        txn.where(paid_renewal(F.col("actual_amount_paid"), F.col("is_cancel")) == 1)
        .groupBy("msno", F.col("transaction_date").alias("date"), "membership_expire_date")
        .agg(F.min(F.struct("actual_amount_paid", "plan_list_price", "payment_plan_days",
                            "payment_method_id", "is_auto_renew")).alias("offer"))
    )
    points = active_churn(events).select("msno", "E", "last_pre_txn_date")
    pairs = binned_interval_join(paid, points, F.col("last_pre_txn_date"), hi)
    first = F.min(F.struct("date", "membership_expire_date", "offer")).alias("t")
    return (
        pairs.where(F.col("membership_expire_date") > F.col("E"))
        .groupBy("msno", "E").agg(F.first("last_pre_txn_date").alias("last_pre_txn_date"), first)
        .select(
            "msno", "E", "last_pre_txn_date", F.col("t.date").alias("transaction_date"),
            "t.membership_expire_date", "t.offer.actual_amount_paid", "t.offer.payment_plan_days",
            F.datediff("E", F.col("t.date")).alias("days_before_E"),
            F.datediff(F.col("t.membership_expire_date"), F.col("E")).alias("extension_days"),
        )
    )


def missed_early_renewals(events: DataFrame, txn: DataFrame) -> DataFrame:
    return paid_extensions(events, txn, F.date_sub("E", 1))


def broad_missed_renewals(events: DataFrame, txn: DataFrame, cfg: StudyConfig) -> DataFrame:
    return paid_extensions(events, txn, F.date_add("E", cfg.grace_days))


def posting_timing(broad: DataFrame) -> DataFrame:
    side = F.when(F.col("transaction_date") < F.col("E"), F.lit("posted before E")).otherwise(
        F.lit("posted on/after E"))
    return counts_by(broad.withColumn("timing", side), "timing")


def first_paid_within(events: DataFrame, txn_days: DataFrame, days: int) -> DataFrame:
    """Events with the day of the first paid transaction in [E, E + days] and whether
    it reaches past E."""

    def measures(frame):
        offer = F.when(F.col("d_first_paid").isNotNull(), F.struct("_day", "d_first_paid"))
        return {
            "_first": F.first(offer, ignorenulls=True).over(frame(0, days)),
            "_at": F.max("_day").over(frame(0, 0)),
        }

    cols = ["msno", "E", "expiry_month", "label", "renewed"]
    seen = along_timeline(events.select(*cols), txn_days, measures)
    return seen.select(
        *cols, (F.col("_first._day") - F.col("_at")).alias("first_paid_day"),
        (F.col("_first.d_first_paid.membership_expire_date") > F.col("E")).alias("first_extends"),
    )


def late_window(events: DataFrame, txn: DataFrame, txn_days: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Adds whether the whole late window lies inside the transaction data."""
    last = txn.agg(F.max("transaction_date")).scalar()
    found = first_paid_within(events, txn_days, cfg.late_grace_days)
    return found.withColumn("observable", F.date_add("E", cfg.late_grace_days) <= last)


def late_renewal_summary(late: DataFrame) -> DataFrame:
    churn = F.col("label") == "CHURN"
    seen = churn & F.col("observable")
    paid = seen & F.col("first_paid_day").isNotNull()
    return late.agg(
        F.count_if(churn).alias("n_churn"), F.count_if(seen).alias("n_observable"),
        F.count_if(paid).alias("n_late"), F.count_if(paid & F.col("first_extends")).alias("n_late_extends"),
    )


def late_renewal_bins(late: DataFrame, edges) -> DataFrame:
    paid = late.where((F.col("label") == "CHURN") & F.col("observable") & F.col("first_paid_day").isNotNull())
    binned = paid.withColumn("bin", right_closed_bin(F.col("first_paid_day"), edges))
    return counts_by(binned.where(F.col("bin").isNotNull()), "bin")


def late_renewal_by_month(late: DataFrame) -> DataFrame:
    seen = late.where((F.col("label") == "CHURN") & F.col("observable"))
    return seen.groupBy("expiry_month").agg(
        (F.avg(F.col("first_paid_day").isNotNull().cast("int")) * 100).alias("late_pct"))


def official_churn(txn: DataFrame, hist: tuple[str, str], expire: tuple[str, str], gap_days: int = 30) -> DataFrame:
    """Churn by the competition's rule, per user: the expiry of the last transaction in
    a history window, pulled earlier by cancels before the first later renewal; churn
    when no renewal follows or it comes `gap_days` or more after that expiry."""
    day = lambda s: F.lit(s).cast("date")
    made = F.col("transaction_date")
    last = F.max(F.struct("transaction_date", "is_cancel", "membership_expire_date")).alias("t")
    cand = (
        txn.where(made.between(day(hist[0]), day(hist[1])))
        .groupBy("msno").agg(last)
        .select("msno", F.col("t.membership_expire_date").alias("last_expire"))
        .where(F.col("last_expire").between(day(expire[0]), day(expire[1])))
    )
    renews = F.col("is_cancel") == 0
    later = (
        txn.where(made > day(hist[1]))
        .groupBy("msno", made.alias("date"))
        .agg(F.max(renews).alias("renews"),
             F.min(F.when(~renews, F.col("membership_expire_date"))).alias("cancel_expire"))
    )
    by_user = W.partitionBy("msno")
    later = (
        later.withColumn("first_ren_date", F.min(F.when(F.col("renews"), F.col("date"))).over(by_user))
        .groupBy("msno")
        .agg(F.first("first_ren_date").alias("first_ren_date"),
             F.min(F.when(F.col("date") < F.col("first_ren_date"), F.col("cancel_expire"))).alias("cancel_min"))
    )
    adjusted = F.least("last_expire", "cancel_min")
    return (
        cand.join(later, "msno", "left")
        .withColumn("gap", F.datediff("first_ren_date", adjusted))
        .withColumn("pred_churn", flag(F.col("first_ren_date").isNull() | (F.col("gap") >= gap_days)))
        .select("msno", "last_expire", "gap", "pred_churn")
    )


def label_agreement(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Coverage of the truth by predictions and accuracy where both exist."""
    both = truth.join(pred.select("msno", "pred_churn"), "msno", "left")
    hit = F.col("pred_churn").isNotNull()
    return both.agg(
        F.count(F.lit(1)).alias("n_truth"), F.count_if(hit).alias("n_matched"),
        F.avg(hit.cast("int")).alias("coverage"),
        F.avg(F.when(hit, (F.col("is_churn") == F.col("pred_churn")).cast("int"))).alias("accuracy"),
        F.avg("is_churn").alias("truth_rate"),
    )


def agreement_table(truth: DataFrame, pred: DataFrame) -> DataFrame:
    return counts_by(truth.join(pred.select("msno", "pred_churn"), "msno"), "is_churn", "pred_churn")


def churn_robustness(events: DataFrame, txn_days: DataFrame, forward_days: int = 30) -> DataFrame:
    """Churn events with coverage already past E or any non-cancel transaction soon after."""
    churn = events.where(F.col("label") == "CHURN").select("msno", "E", "expiry_month")
    covering = txn_days.select(
        "msno", "date", "d_cover_end", F.col("d_cover_end").isNotNull().cast("long").alias("d_open"))

    def measures(frame):
        return {
            "cover_end": F.max("d_cover_end").over(frame(None, 0)),
            "_forward": window_total("d_open", frame, 1, forward_days),
        }

    return (
        along_timeline(churn, covering, measures)
        .withColumn("pushback", flag(F.col("cover_end") > F.col("E")))
        .withColumn("days_past", F.datediff("cover_end", "E"))
        .withColumn("forward", flag(F.col("_forward") > 0))
        .drop("_forward")
    )


def robustness_summary(robust: DataFrame) -> DataFrame:
    either = F.greatest("pushback", "forward")
    return robust.agg(
        F.count(F.lit(1)).alias("n_churn"), F.sum("pushback").alias("n_pushback"),
        F.sum("forward").alias("n_forward"), F.sum(either).alias("n_either"),
        (F.count(F.lit(1)) - F.sum(either)).alias("n_survive"),
    )


def robustness_by_month(robust: DataFrame) -> DataFrame:
    return robust.groupBy("expiry_month").agg(
        (F.avg("pushback") * 100).alias("pushback_pct"), F.count(F.lit(1)).alias("n"))


def pushback_quantiles(robust: DataFrame) -> DataFrame:
    pushed = robust.where(F.col("pushback") == 1)
    q = quantile_columns(pushed, [], "days_past", {"median": 0.5, "p90": 0.9})
    return q.withColumn("longest", pushed.agg(F.max("days_past")).scalar())


def next_labels(events: DataFrame) -> DataFrame:
    """Each event with the label of the user's next one."""
    w = W.partitionBy("msno").orderBy("E")
    return events.select("msno", "E", "label").withColumn("next_label", F.lead("label").over(w))


def transition_matrix(events: DataFrame) -> DataFrame:
    pairs = next_labels(events).dropna(subset=["next_label"])
    return crosstab_shares(pairs, "label", "next_label")


def contract_checks(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """(rule, violations): every count must be zero."""
    m = F.col("label") != "INSUFFICIENT_DATA"
    checks = {
        "churn_iff_not_renewed": m & ((F.col("renewed") == 0) != (F.col("label") == "CHURN")),
        "movement_needs_evidence": m & (F.col("has_pre_evidence") == 0),
        "stable_outside_band": (F.col("label") == "STABLE") & ~F.col("vol_ratio").between(cfg.vol_low, cfg.vol_high),
        "renewed_is_no_flag": ~F.coalesce(F.col("renewed").isin(0, 1), F.lit(False)),
    }
    row = events.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    return row.unpivot([], list(checks), "rule", "violations")


def reconstruction_error(a: DataFrame, b: DataFrame, keys, col_a: str, col_b: str) -> DataFrame:
    """Largest and mean absolute difference of two columns matched on keys."""
    both = a.join(b, list(keys)).where(F.col(col_a).isNotNull() & F.col(col_b).isNotNull())
    diff = F.abs(F.col(col_a) - F.col(col_b))
    return both.agg(F.max(diff).alias("max_diff"), F.avg(diff).alias("mean_diff"), F.count(F.lit(1)).alias("n"))
