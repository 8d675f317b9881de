"""Transaction state of a user as known at a decision date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from renewscope.functions.scalar import safe_ratio
from renewscope.operators.quantiles import value_bucket
from renewscope.operators.timeline import along_timeline, running_total
from renewscope.session import through_table

# Event-defining transaction columns, raw name to feature name.
EVENT_FIELDS = {
    "plan_list_price": "pre_list_price",
    "actual_amount_paid": "pre_amount_paid",
    "payment_plan_days": "payment_plan_days",
    "payment_method_id": "payment_method_id",
    "is_auto_renew": "is_auto_renew",
    "is_cancel": "is_cancel",
}


def decision_dates(events: DataFrame, cutoffs) -> DataFrame:
    """(msno, E, cutoff_days, dec): one row per event and cutoff."""
    return events.select(
        "msno", "E", F.explode(F.array(*[F.lit(int(c)) for c in cutoffs])).alias("cutoff_days")
    ).withColumn("dec", F.date_sub("E", F.col("cutoff_days")))


def running_history(points: DataFrame, txn_days: DataFrame, at: str = "dec") -> DataFrame:
    """Points with counts, sums, first and last dates of transactions strictly before
    the date, and the last transaction on or before it. Points must be few per user
    and day; facts are per user and day, so one user's work is bounded by the calendar."""

    def measures(frame):
        before = frame(None, -1)
        is_fact = F.col("d_txns").isNotNull()
        day = F.when(is_fact, F.col("_day"))
        return {
            "n_hist": running_total("d_txns", frame, -1),
            "n_prior_renewals": running_total("d_paid", frame, -1),
            "n_prior_cancels": running_total("d_cancels", frame, -1),
            "n_prior_autorenew": running_total("d_autorenew", frame, -1),
            "_price": running_total("d_price", frame, -1),
            "_priced": running_total("d_priced", frame, -1),
            "_first_day": F.min(day).over(before),
            "_last_day": F.max(day).over(before),
            "_as_of": F.last("d_last", ignorenulls=True).over(frame(None, 0)),
            "_at": F.max("_day").over(frame(0, 0)),
        }

    seen = along_timeline(points, txn_days, measures, at=at)
    n = F.col("n_hist")
    return seen.select(
        *points.columns,
        *[F.col(f"_as_of.{raw}").alias(name) for raw, name in EVENT_FIELDS.items()],
        F.when(n > 0, n).alias("n_hist_txns"),
        safe_ratio(F.col("_price"), F.col("_priced")).alias("mean_hist_price"),
        safe_ratio(F.col("n_prior_cancels"), n).alias("cancel_rate"),
        safe_ratio(F.col("n_prior_autorenew"), n).alias("auto_renew_rate"),
        (F.col("_at") - F.col("_first_day")).alias("tenure_days"),
        (F.col("_at") - F.col("_last_day")).alias("recency_days"),
        (n > 0).cast("int").alias("has_hist_txn"),
        *[F.col(c).cast("int").alias(c)
          for c in ("n_prior_renewals", "n_prior_cancels", "n_prior_autorenew")],
        F.coalesce(safe_ratio(F.col("n_prior_renewals"), n), F.lit(0.0)).alias("prior_renewal_rate"),
        F.col("_as_of").isNotNull().alias("_has_as_of"),
    )


def running_counts(facts: DataFrame, grid: DataFrame, category: str, at: str) -> DataFrame:
    """Rows of `grid` (msno, at, category, ...) with `n`, the number of facts of that user
    and category strictly before the date.

    `facts` has one row per user, day and category, so this is a running total per
    (user, category): days and dates are never paired with each other.
    """
    daily = facts.select("msno", "date", category, F.col("n").alias("d_n"))

    def measures(frame):
        return {"n": running_total("d_n", frame, -1)}

    return along_timeline(grid, daily, measures, key=["msno", category], at=at)


def _daily(txn: DataFrame, *cats) -> DataFrame:
    return txn.groupBy("msno", F.col("transaction_date").alias("date"), *cats).agg(F.count(F.lit(1)).alias("n"))


def history_modes(points: DataFrame, txn: DataFrame, at: str = "dec") -> DataFrame:
    """(msno, at, mode_pay_method): commonest method strictly before, smallest on ties.
    Methods are a code list, so a user has few of them."""
    daily = _daily(txn.where(F.col("payment_method_id").isNotNull()), "payment_method_id")
    grid = points.select("msno", at).distinct().join(
        daily.select("msno", "payment_method_id").distinct().hint("merge"), "msno")
    counted = running_counts(daily, grid, "payment_method_id", at).where(F.col("n") > 0)
    most = F.max("n").over(W.partitionBy("msno", at))
    return counted.withColumn("most", most).where(F.col("n") == F.col("most")).groupBy("msno", at).agg(
        F.min("payment_method_id").alias("mode_pay_method"))


def _middle_ranks(total: Column) -> Column:
    return F.array_distinct(F.array(F.floor((total - 1) / 2), F.floor(total / 2)))


def _pick(counted: DataFrame, category: str, at: str, *within: str) -> DataFrame:
    """Rows of the category that holds the wanted rank, and the rank's place inside it."""
    ordered = W.partitionBy("msno", at, *within, "rank").orderBy(category)
    upto = F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        counted.withColumn("_upto", upto)
        .where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("n")))
        .withColumn("_inside", F.col("rank") - (F.col("_upto") - F.col("n")))
    )


def _median_of(picked: DataFrame, value: str, at: str) -> DataFrame:
    """Mean of the one or two middle values."""
    return picked.groupBy("msno", at).agg(
        ((F.min(value) + F.max(value)) / F.lit(2.0)).alias("median_hist_paid"))


def _ranked_grid(counted: DataFrame, at: str) -> DataFrame:
    whole = W.partitionBy("msno", at)
    kept = counted.where(F.col("n") > 0).withColumn("_total", F.sum("n").over(whole))
    return kept.withColumn("rank", F.explode(_middle_ranks(F.col("_total")))).drop("_total")


def history_medians(points: DataFrame, txn: DataFrame, at: str = "dec") -> DataFrame:
    """(msno, at, median_hist_paid): exact median of amounts paid strictly before, for every
    user alike, whatever the number of dates and distinct amounts.

    Amounts are counted in coarse buckets first, whose number is bounded; the bucket
    holding the middle rank is counted in finer buckets and only the last, narrow one
    by value. Each level is a running total per (user, bucket), so a user's rows spread
    over buckets and dates are never paired with transactions.
    """
    points = points.select("msno", at).distinct()
    txn = txn.where(F.col("actual_amount_paid").isNotNull())
    steps = (64, 64 * 64)
    value = F.col("actual_amount_paid")
    rows = txn.select(
        "msno", "transaction_date", value.alias("value"),
        *[value_bucket(value, s).alias(f"b{i}") for i, s in enumerate(steps)])
    levels = ["b0", "b1", "value"]
    daily = _daily(rows, "b0")
    # Sizes of written and exploded tables are estimated far too low for Spark to choose a broadcast by them.
    grid = points.join(daily.select("msno", "b0").distinct().hint("merge"), "msno")
    # Each level reads the one before several times: write it once and cut the lineage.
    picked = through_table(_pick(_ranked_grid(running_counts(daily, grid, "b0", at), at), "b0", at), "median")
    for parent, child in zip(levels, levels[1:]):
        # The finer buckets nest in the coarser ones.
        targets = picked.select("msno", at, parent, F.col("_inside").alias("rank"))
        wanted = targets.select("msno", parent).distinct()
        daily = _daily(rows.join(wanted.hint("merge"), ["msno", parent], "left_semi"), parent, child)
        inside = targets.join(daily.select("msno", parent, child).distinct().hint("merge"), ["msno", parent])
        # Both middle ranks may lie in one bucket with different positions.
        counted = running_counts(daily, inside, child, at).where(F.col("n") > 0)
        picked = through_table(_pick(counted, child, at, parent), "median")
    return _median_of(picked, "value", at)


#: Transactions up to which a user's history is read as one array; this bounds its size.
GATHERED = 256


def gathered_history(points: DataFrame, txn: DataFrame, at: str = "dec") -> DataFrame:
    """Points with `median_hist_paid` and `mode_pay_method` of the transactions strictly before the date, of users
    who have few of them: a user's transactions meet the points as one array in the order of their amounts.
    Undated transactions count as earlier ones, as they do on a timeline."""
    arrays = txn.groupBy("msno").agg(F.sort_array(F.collect_list(F.struct(
        F.col("actual_amount_paid").alias("paid"), F.col("payment_method_id").alias("method"),
        F.col("transaction_date").alias("day")))).alias("_all"))
    before = F.filter("_all", lambda t: F.col(at).isNotNull() & F.coalesce(t["day"] < F.col(at), F.lit(True)))
    seen = points.join(arrays.hint("merge"), "msno", "left").withColumn("_seen", before).drop("_all")
    seen = seen.withColumns({
        "_paid": F.filter(F.transform("_seen", lambda t: t["paid"]), lambda v: v.isNotNull()),
        "_by": F.filter(F.transform("_seen", lambda t: t["method"]), lambda m: m.isNotNull())})
    n = F.size("_paid")
    middle = [F.get("_paid", F.floor(i / 2).cast("int")) for i in (n - 1, n)]
    counted = F.transform(F.array_distinct("_by"), lambda m: F.struct(
        (-F.size(F.filter("_by", lambda x: x == m))).alias("less"), m.alias("method")))
    return seen.withColumns({
        "median_hist_paid": F.when(n > 0, (middle[0] + middle[1]) / F.lit(2.0)),
        "mode_pay_method": F.array_min(counted)["method"],
    }).drop("_seen", "_paid", "_by")


def with_history(points: DataFrame, txn: DataFrame, txn_days: DataFrame, at: str = "dec") -> DataFrame:
    """All transaction features of each point.

    Users with more than GATHERED transactions, of whom there are few, take the way that spreads
    a user's rows; the others' arrays lie where the timelines already are."""
    keys = ["msno", at]
    named = txn.where(F.col("msno").isNotNull())
    many = named.groupBy("msno").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GATHERED).select("msno")
    many = through_table(many, "many-transactions")
    base = running_history(points, txn_days, at)
    if many.isEmpty():
        return gathered_history(base, named, at)
    few = gathered_history(base, named.join(many, "msno", "left_anti"), at)
    their_points, theirs = (df.join(many, "msno", "left_semi") for df in (points, named))
    return (
        few.withColumnsRenamed({"median_hist_paid": "_median", "mode_pay_method": "_mode"})
        .join(history_medians(their_points, theirs, at).hint("merge"), keys, "left")
        .join(history_modes(their_points, theirs, at).hint("merge"), keys, "left")
        .withColumns({"median_hist_paid": F.coalesce("median_hist_paid", "_median"),
                      "mode_pay_method": F.coalesce("mode_pay_method", "_mode")})
        .drop("_median", "_mode")
    )
