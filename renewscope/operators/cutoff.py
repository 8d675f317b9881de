"""Features rebuilt at earlier decision dates, as if later data did not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewscope.config import StudyConfig
from renewscope.functions.scalar import safe_ratio
from renewscope.operators.history import EVENT_FIELDS, decision_dates, with_history

HISTORY_FEATURES = (
    "n_hist_txns", "mean_hist_price", "median_hist_paid", "cancel_rate", "auto_renew_rate",
    "mode_pay_method", "tenure_days", "recency_days", "has_hist_txn",
    "n_prior_renewals", "n_prior_cancels", "n_prior_autorenew", "prior_renewal_rate",
)
COUNT_FEATURES = ("n_prior_renewals", "n_prior_cancels", "n_prior_autorenew")


def transaction_features_at(events: DataFrame, txn: DataFrame, txn_days: DataFrame,
                            cutoffs, mode: str = "uniform") -> DataFrame:
    """(msno, E, cutoff_days) with event-transaction and history features at E - c.

    All cutoffs are rebuilt in one job. In `reference` mode two quirks of the
    published tables are kept for c > 0: a missing history counts as 0 rather than
    NULL, and an event with no transaction at all by then has NULL in every field.
    """
    points = decision_dates(events, cutoffs)
    built = with_history(points, txn, txn_days)
    if mode == "reference":
        early = F.col("cutoff_days") > 0
        counted = F.coalesce(F.col("n_hist_txns"), F.lit(0).cast("long"))
        nothing = early & ~F.col("_has_as_of")
        built = built.withColumn("n_hist_txns", F.when(early, counted).otherwise(F.col("n_hist_txns")))
        built = built.withColumns({
            c: F.when(~nothing, F.col(c))
            for c in ("n_hist_txns", "has_hist_txn", "prior_renewal_rate", *COUNT_FEATURES)
        })
    elif mode != "uniform":
        raise ValueError(f"unknown mode {mode!r}")
    return built.select("msno", "E", "cutoff_days", *EVENT_FIELDS.values(), *HISTORY_FEATURES)


def _by_cutoff(cutoffs, pick) -> Column:
    expr = None
    for c in cutoffs:
        cond, value = F.col("cutoff_days") == c, pick(c)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr


def cutoff_matrix(events: DataFrame, txn: DataFrame, txn_days: DataFrame, cfg: StudyConfig,
                  carried=(), mode: str = "uniform") -> DataFrame:
    """One row per (msno, E, cutoff): every base feature as of E - c.

    `events` carries the usage windows. The usage window at c is the horizon of the
    same length; the personal baseline is the lifetime total less the last c days.
    At c = 0 the event's own transaction is used, otherwise the latest one by E - c.
    """
    features = transaction_features_at(events, txn, txn_days, cfg.cutoffs, mode)
    own = [F.col(c).alias(f"_own_{c}") for c in EVENT_FIELDS.values()]
    base = events.select(
        "msno", "E", *carried, *own,
        "pre_total_secs", "pre_n_days", "pre_rate", "obs_secs_full", "obs_ndays_full",
        *[f"h{c}_{s}" for c in cfg.cutoffs if c for s in ("secs", "ndays", "rate")],
        *[f"recent_{s}_{c}" for c in cfg.cutoffs if c for s in ("secs", "ndays")],
    )
    # Rows of the cohort, whose written size is far below that in memory: no broadcast.
    joined = features.join(base.hint("merge"), ["msno", "E"])
    zero = F.lit(0.0)
    usage = {
        "pre_total_secs": _by_cutoff(cfg.cutoffs, lambda c: F.col(f"h{c}_secs" if c else "pre_total_secs")),
        "pre_n_days": _by_cutoff(cfg.cutoffs, lambda c: F.col(f"h{c}_ndays" if c else "pre_n_days")),
        "pre_rate": _by_cutoff(cfg.cutoffs, lambda c: F.col(f"h{c}_rate" if c else "pre_rate")),
        "_secs": F.greatest(F.col("obs_secs_full") - _by_cutoff(
            cfg.cutoffs, lambda c: F.col(f"recent_secs_{c}") if c else zero), zero),
        "_days": F.greatest(F.col("obs_ndays_full") - _by_cutoff(
            cfg.cutoffs, lambda c: F.col(f"recent_ndays_{c}") if c else F.lit(0)), F.lit(0)),
    }
    own_event = {
        c: F.when(F.col("cutoff_days") == 0, F.col(f"_own_{c}")).otherwise(F.col(c))
        for c in EVENT_FIELDS.values()
    }
    built = joined.withColumns(usage).withColumns(own_event)
    built = built.withColumn("obs_secs_per_active_day", safe_ratio(F.col("_secs"), F.col("_days")))
    built = built.withColumn(
        "recent_vs_life_ratio", safe_ratio(F.col("pre_rate"), F.col("obs_secs_per_active_day")))
    return built.select(
        "msno", "E", "cutoff_days", *carried, "pre_total_secs", "pre_n_days", "pre_rate",
        *EVENT_FIELDS.values(), *HISTORY_FEATURES, "obs_secs_per_active_day", "recent_vs_life_ratio",
    )


def hide_unknown_horizons(df: DataFrame, cfg: StudyConfig, cutoff: Column) -> DataFrame:
    """Horizon features whose window ends after the decision date become 0."""
    cols = {}
    for h in cfg.horizons:
        for stat in ("secs", "ndays", "rate", "active"):
            name = f"h{h}_{stat}"
            cols[name] = F.when(F.lit(h) >= cutoff, F.col(name)).otherwise(F.lit(0))
    return df.withColumns(cols)


def usage_features_at(events: DataFrame, days: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The baseline at E - c summed directly, to check the subtraction against."""
    from renewscope.functions.scalar import from_micros
    from renewscope.operators.timeline import along_timeline, running_total

    def measures(frame):
        out = {}
        for c in cfg.cutoffs:
            out[f"_m{c}"] = running_total("d_micros", frame, -(c + 1))
            out[f"_r{c}"] = running_total("d_rows", frame, -(c + 1))
        return out

    seen = along_timeline(events.select("msno", "E"), days.select("msno", "date", "d_micros", "d_rows"), measures)
    rows = F.explode(F.array(*[
        F.struct(F.lit(int(c)).alias("cutoff_days"), from_micros(F.col(f"_m{c}")).alias("base_secs"),
                 F.col(f"_r{c}").cast("int").alias("base_days"))
        for c in cfg.cutoffs
    ]))
    return seen.select("msno", "E", rows.alias("r")).select("msno", "E", "r.*")
