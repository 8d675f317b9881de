"""Interval joins through day bins, for results that do need the matching pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewscope.functions.scalar import day_number


def binned_interval_join(facts: DataFrame, points: DataFrame, lo: Column, hi: Column,
                         key: str = "msno", day: str = "date", bin_days: int = 32) -> DataFrame:
    """Pairs with the same key and `lo <= day <= hi`, an interval given per point.

    Each point is repeated once per bin its interval touches and each fact has one
    bin, so the join is an equi-join on (key, bin): a user's rows spread over bins
    and only facts near the interval are compared.
    """
    to_bin = lambda c: F.floor(c / F.lit(bin_days)).cast("int")
    left = facts.withColumn("_day", day_number(F.col(day))).withColumn("_bin", to_bin(F.col("_day")))
    right = (
        points.withColumn("_lo", day_number(lo))
        .withColumn("_hi", day_number(hi))
        .where(F.col("_lo") <= F.col("_hi"))
        .withColumn("_bin", F.explode(F.sequence(to_bin(F.col("_lo")), to_bin(F.col("_hi")))))
    )
    return (
        left.join(right, [key, "_bin"])
        .where(F.col("_day").between(F.col("_lo"), F.col("_hi")))
        .drop("_bin", "_day", "_lo", "_hi")
    )


def plain_interval_join(facts: DataFrame, points: DataFrame, lo: Column, hi: Column,
                        key: str = "msno", day: str = "date") -> DataFrame:
    """The same pairs through an equi-join on the key alone; kept for comparison."""
    return (
        facts.join(points.withColumn("_lo", lo).withColumn("_hi", hi), key)
        .where(F.col(day).between(F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )
