"""Member demographics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewscope.config import StudyConfig
from renewscope.functions.scalar import keep_between, parse_yyyymmdd

DEMOGRAPHICS = ("city", "bd", "gender", "registered_via", "registration_init_time")


def clean_members(members: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Lenient registration date; implausible ages become NULL."""
    return members.select(
        "msno", "city", keep_between(F.col("bd"), *cfg.age_build).alias("bd"), "gender",
        "registered_via",
        parse_yyyymmdd(F.col("registration_init_time"), strict=False).alias("registration_init_time"),
    )


def with_demographics(events: DataFrame, members: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Left join by user; a user that is missing or unknown keeps NULLs. Whether the
    member table is small enough to broadcast is decided from its measured size."""
    return events.join(clean_members(members, cfg), "msno", "left")
