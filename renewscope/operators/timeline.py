"""As-of, running-total and interval aggregates along each user's calendar.

Points (for example expiry events) and facts already reduced to one row per user
and day are laid on one timeline per user and read with window frames. Nothing is
multiplied: the work is rows of facts plus rows of points, one shuffle and one sort
on the user, and because facts are per day a user's timeline is bounded by the
calendar even when that user owns a third of the raw rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from renewscope.functions.scalar import day_number

Frame = Callable[[int | None, int | None], WindowSpec]


def along_timeline(points: DataFrame, facts: DataFrame, measures: Callable[[Frame], Mapping[str, Column]],
                   key: str | list[str] = "msno", at: str = "E", day: str = "date") -> DataFrame:
    """Each point with aggregates over the facts of the same key.

    `measures` receives `frame(lo, hi)`: the window of rows whose day lies between
    point + lo and point + hi, both inclusive, None meaning unbounded.
    """
    marked = points.withColumn("_day", day_number(F.col(at))).withColumn("_point", F.lit(True))
    daily = facts.withColumn("_day", day_number(F.col(day)))
    if day != at:
        daily = daily.drop(day)
    both = marked.unionByName(daily, allowMissingColumns=True)
    ordered = W.partitionBy(key).orderBy("_day")

    def frame(lo: int | None, hi: int | None) -> WindowSpec:
        first = W.unboundedPreceding if lo is None else lo
        last = W.unboundedFollowing if hi is None else hi
        return ordered.rangeBetween(first, last)

    found = measures(frame)
    read = both.select("*", *[c.alias(name) for name, c in found.items()])
    return read.where("_point").select(*points.columns, *found)


def running_total(measure: str, frame: Frame, upto: int) -> Column:
    """Sum of an integer measure over all days up to point + upto."""
    return F.coalesce(F.sum(measure).over(frame(None, upto)), F.lit(0).cast("long"))


def window_total(measure: str, frame: Frame, lo: int, hi: int) -> Column:
    """Exact interval sum as a difference of two running totals.

    Running frames only ever grow, so Spark updates them with one step per row;
    a sliding frame would be summed again for every row.
    """
    return running_total(measure, frame, hi) - running_total(measure, frame, lo - 1)
