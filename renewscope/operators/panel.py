"""Daily sequence panel and its dense per-event arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewscope.config import PANEL_CHANNELS, StudyConfig
from renewscope.functions.scalar import from_micros
from renewscope.operators.ranges import binned_interval_join
from renewscope.operators.usage import usage_days


def daily_panel(events: DataFrame, logs: DataFrame, cfg: StudyConfig, window: int | None = None) -> DataFrame:
    """(msno, E, offset, channels): one row per event and active day before E.

    The log is reduced to one row per user and day first and matched through day bins
    of the window's length, so an event meets at most two bins.
    """
    window = window or cfg.seq_window
    points = events.select("msno", "E")
    pairs = binned_interval_join(
        usage_days(logs, cfg), points, F.date_sub("E", window), F.date_sub("E", 1), bin_days=window)
    return pairs.select(
        "msno", "E", F.datediff("date", "E").alias("offset"),
        from_micros(F.col("d_micros")).alias("total_secs"),
        *[F.col(c).cast("long").alias(c) for c in PANEL_CHANNELS[1:]],
    )


def dense_sequence(panel: DataFrame, events: DataFrame, window: int,
                   channels: Sequence[str] = PANEL_CHANNELS) -> DataFrame:
    """(msno, E, seq): `window` days × channels per event, zeros where nothing happened.

    Position 0 is day E - window, the last position is E - 1. Events without any usage
    keep an all-zero sequence; rows of unknown events are dropped; an event listed
    twice appears once. At most `window` rows are gathered per event.
    """
    keys = events.select("msno", "E").dropDuplicates(["msno", "E"])
    vector = F.array(*[F.col(c).cast("float") for c in channels])
    inside = panel.where(F.col("offset").between(-window, -1))
    # One row per day: several rows of a day count once, the largest by channel order.
    by_day = inside.groupBy("msno", "E", "offset").agg(F.max(vector).alias("v"))
    gathered = by_day.groupBy("msno", "E").agg(F.map_from_entries(
        F.collect_list(F.struct("offset", "v"))).alias("m"))
    zero = F.array(*[F.lit(0.0).cast("float")] * len(channels))
    days = F.sequence(F.lit(-window), F.lit(-1))
    seq = F.transform(days, lambda d: F.coalesce(F.try_element_at(F.col("m"), d), zero))
    return keys.join(gathered, ["msno", "E"], "left").select("msno", "E", seq.alias("seq"))


def slide(seq: Column, deep: int, window: int, cutoff: int) -> Column:
    """The `window` days that end `cutoff` days before E, out of a deep sequence."""
    return F.slice(seq, deep - window - cutoff + 1, window)


def has_activity(seq: Column) -> Column:
    return F.exists(seq, lambda day: F.exists(day, lambda x: x != 0))


def sequence_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest absolute difference between two dense tables of equal shape."""
    both = a.select("msno", "E", F.flatten("seq").alias("x")).join(
        b.select("msno", "E", F.flatten("seq").alias("y")), ["msno", "E"])
    gap = F.array_max(F.zip_with("x", "y", lambda x, y: F.abs(x - y)))
    return both.agg(F.max(gap).cast("double").alias("max_diff"), F.count(F.lit(1)).alias("n"))


def channel_statistics(dense: DataFrame, cfg: StudyConfig,
                       channels: Sequence[str] = PANEL_CHANNELS) -> DataFrame:
    """(channel, mean, std) of log1p values over days with any activity; population
    standard deviation plus 1e-6."""
    days = dense.select(F.explode("seq").alias("day")).where(F.exists("day", lambda x: x != 0))
    aggs = []
    for i, c in enumerate(channels):
        v = F.log1p(F.least(F.greatest(F.col("day")[i].cast("double"), F.lit(0.0)), F.lit(cfg.seq_clip)))
        aggs += [F.avg(v).alias(f"m{i}"), (F.stddev_pop(v) + 1e-6).alias(f"s{i}")]
    row = days.agg(*aggs)
    parts = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"m{i}").alias("mean"),
                               F.col(f"s{i}").alias("std")) for i, c in enumerate(channels)])
    return row.select(F.explode(parts).alias("p")).select("p.*")


def normalise_sequences(dense: DataFrame, stats: DataFrame, cfg: StudyConfig,
                        channels: Sequence[str] = PANEL_CHANNELS) -> DataFrame:
    """Clip, log1p and standardise each channel with statistics fitted elsewhere.

    The statistics are one struct of numbers, read by position: a map would be searched by
    name again for every value. Days without activity are all alike and computed once.
    """
    fitted = stats.groupBy().agg(*[
        F.max(F.when(F.col("channel") == c, F.col(s))).alias(f"{s}{i}")
        for i, c in enumerate(channels) for s in ("mean", "std")])
    zero = F.array(*[F.lit(0.0).cast("float")] * len(channels))

    def scaled(day, stat):
        return F.array(*[
            (F.log1p(F.least(F.greatest(day[i].cast("double"), F.lit(0.0)), F.lit(cfg.seq_clip)))
             - stat(f"mean{i}")) / stat(f"std{i}")
            for i in range(len(channels))])

    numbers = F.struct("*", scaled(zero, F.col).alias("idle")).alias("st")
    out = dense.withColumn("_st", fitted.select(numbers).scalar())
    read = F.col("_st").getField
    day_of = lambda day: F.when(day == zero, read("idle")).otherwise(scaled(day, read))
    return out.withColumn("seq", F.transform("seq", day_of)).drop("_st")


def channel_totals(dense: DataFrame, channels: Sequence[str] = PANEL_CHANNELS) -> DataFrame:
    """(channel, total) over all days of all events, summed event by event and all channels in
    one walk over a sequence."""
    zero = F.array(*[F.lit(0.0)] * len(channels))
    by_event = dense.select(F.aggregate("seq", zero, lambda total, day: F.array(*[
        total[i] + day[i] for i in range(len(channels))])).alias("sums"))
    totals = by_event.agg(*[F.sum(F.col("sums")[i]).alias(c) for i, c in enumerate(channels)])
    return totals.unpivot([], list(channels), "channel", "total")
