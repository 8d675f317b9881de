"""Trajectory label and its companion flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewscope.config import StudyConfig
from renewscope.functions.scalar import flag, trajectory_label


def with_label(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    pre_ok = F.col("pre_n_days") >= cfg.min_days
    post_ok = F.col("post_n_days") >= cfg.min_days
    silent = F.col("post_total_secs") == 0
    return events.withColumns({
        "label": trajectory_label(cfg),
        "is_silent_renewer": flag((F.col("renewed") == 1) & silent),
        "has_pre_evidence": flag(pre_ok),
        "has_post_evidence": flag(post_ok),
        "has_evidence": flag(pre_ok & post_ok),
        "post_observed_but_silent": flag(post_ok & silent),
    })


def core(events: DataFrame) -> DataFrame:
    """Events with a label that can be modelled."""
    return events.where(F.col("label") != "INSUFFICIENT_DATA")
