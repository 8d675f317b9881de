"""Usage around the expiry and before it, all from one pass over the daily log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewscope.config import PANEL_CHANNELS, StudyConfig
from renewscope.functions.scalar import clip, from_micros, safe_ratio, to_micros
from renewscope.operators.timeline import along_timeline, running_total, window_total


def usage_days(logs: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Log rows reduced to one row per user and day, seconds limited row by row first."""
    secs = to_micros(clip(F.col("total_secs"), cfg.min_secs, cfg.max_secs))
    counts = [F.sum(c).alias(c) for c in PANEL_CHANNELS if c != "total_secs" and c in logs.columns]
    return logs.groupBy("msno", "date").agg(
        F.coalesce(F.sum(secs), F.lit(0).cast("long")).alias("d_micros"),
        F.count(F.lit(1)).alias("d_rows"),
        F.lit(1).cast("long").alias("d_days"),
        *counts,
    )


def usage_near(logs: DataFrame, cfg: StudyConfig, before: int | None, after: int) -> DataFrame:
    """Log rows that some event of the study's cohort can look at: from `before` days ahead of its
    first day (None: from the beginning) to `after` days past its last. The bounds are values of
    the study, so they reach the scan."""
    first, last = (F.lit(x).cast("date") for x in (cfg.cohort_start, cfg.cohort_end))
    kept = logs.where(F.col("date") <= F.date_add(last, after))
    return kept if before is None else kept.where(F.col("date") >= F.date_sub(first, before))


def usage_windows(events: DataFrame, days: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Every usage total of an event: before and after E, all horizons, the whole
    history and the last c days. The reference scans its log once for each of these
    groups; here they are running totals read in the same window pass."""
    w, ob = cfg.window_days, cfg.obs_len

    def measures(frame):
        out = {
            "_pre_micros": window_total("d_micros", frame, -w, -1),
            "_pre_days": window_total("d_days", frame, -w, -1),
            "_post_micros": window_total("d_micros", frame, 1, w),
            "_post_days": window_total("d_days", frame, 1, w),
            "_life_micros": running_total("d_micros", frame, -1),
            "_life_rows": running_total("d_rows", frame, -1),
        }
        for h in cfg.horizons:
            out[f"_h{h}_micros"] = window_total("d_micros", frame, -(h + ob), -(h + 1))
            out[f"_h{h}_rows"] = window_total("d_rows", frame, -(h + ob), -(h + 1))
        for c in cfg.cutoffs:
            if c:
                out[f"_recent{c}_micros"] = window_total("d_micros", frame, -c, -1)
                out[f"_recent{c}_rows"] = window_total("d_rows", frame, -c, -1)
        return out

    seen = along_timeline(events, days.select("msno", "date", "d_micros", "d_rows", "d_days"), measures)
    cols = {
        "pre_total_secs": from_micros(F.col("_pre_micros")),
        "pre_n_days": F.col("_pre_days").cast("int"),
        "post_total_secs": from_micros(F.col("_post_micros")),
        "post_n_days": F.col("_post_days").cast("int"),
        "obs_secs_full": from_micros(F.col("_life_micros")),
        "obs_ndays_full": F.col("_life_rows").cast("int"),
    }
    for h in cfg.horizons:
        secs, rows = from_micros(F.col(f"_h{h}_micros")), F.col(f"_h{h}_rows").cast("int")
        cols[f"h{h}_secs"] = secs
        cols[f"h{h}_ndays"] = rows
        cols[f"h{h}_rate"] = safe_ratio(secs, rows)
        cols[f"h{h}_active"] = rows / F.lit(ob)
    for c in cfg.cutoffs:
        if c:
            cols[f"recent_secs_{c}"] = from_micros(F.col(f"_recent{c}_micros"))
            cols[f"recent_ndays_{c}"] = F.col(f"_recent{c}_rows").cast("int")
    read = seen.select(*events.columns, *[v.alias(k) for k, v in cols.items()])
    ratios = {
        "pre_rate": safe_ratio(F.col("pre_total_secs"), F.col("pre_n_days")),
        "post_rate": safe_ratio(F.col("post_total_secs"), F.col("post_n_days")),
        "vol_ratio": safe_ratio(F.col("post_total_secs"), F.col("pre_total_secs")),
        "obs_secs_per_active_day": safe_ratio(F.col("obs_secs_full"), F.col("obs_ndays_full")),
    }
    return read.withColumns(ratios).withColumn(
        "recent_vs_life_ratio",
        safe_ratio(F.col("pre_rate"), F.col("obs_secs_per_active_day")),
    )


def cohort_usage(days: DataFrame, events: DataFrame) -> DataFrame:
    """Daily usage of cohort users only.

    It follows the reduction to days: where the user set is small enough to broadcast,
    Spark itself moves this semi join below that aggregate and filters before the
    shuffle; where it is not, a hot user has already shrunk to one row per day.
    """
    return days.join(events.select("msno").distinct(), "msno", "left_semi")
