"""Views of general tables as the three study inputs.

Orders with their line items read as a long, sparse subscription history; an event
stream reads as a short, dense one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewscope.config import EVENTS_STUDY, ORDERS_STUDY, StudyConfig
from renewscope.sources.raw import stored_bytes


@dataclass(frozen=True)
class StudyInputs:
    transactions: DataFrame
    usage: DataFrame
    members: DataFrame | None
    cfg: StudyConfig


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of the usage view are aggregated and sorted in pieces of this much Parquet. Spark would
# merge partitions up to a size in compressed bytes, whose rows take thirty times that in memory.
PIECE_BYTES = 8_000_000


def usage_pieces(spark: SparkSession, *paths: str) -> int | None:
    """Partitions in which a task's rows stay as many at any size of the input."""
    needed = -(-stored_bytes(spark, *paths) // PIECE_BYTES)
    return max(needed, spark.sparkContext.defaultParallelism) if needed > 1 else None


# Plan lengths offered by the orders view, by o_orderkey modulo 4.
PLAN_DAYS = (30, 90, 180, 365)


def orders_transactions(orders: DataFrame) -> DataFrame:
    made = F.col("o_orderdate").cast("date")
    plan = F.get(F.array(*[F.lit(d) for d in PLAN_DAYS]), (F.col("o_orderkey") % 4).cast("int"))
    price = F.round("o_totalprice").cast("long")
    return orders.select(
        F.col("o_custkey").cast("string").alias("msno"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("payment_method_id"),
        plan.cast("long").alias("payment_plan_days"),
        price.alias("plan_list_price"),
        F.when(F.col("o_orderstatus") == "P", F.lit(0)).otherwise(price).cast("long")
        .alias("actual_amount_paid"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("long").alias("is_auto_renew"),
        made.alias("transaction_date"),
        F.date_add(made, plan).alias("membership_expire_date"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0)).cast("long").alias("is_cancel"),
    )


def orders_usage(orders: DataFrame, lineitem: DataFrame, pieces: int | None = None) -> DataFrame:
    """Line items as one usage row per user and day. With `pieces` the join and the aggregate
    run in that many partitions each, by order and by user and day."""

    def dealt(df, *keys):
        return df.repartition(pieces, *keys) if pieces else df

    owner = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("msno"))
    lines = lineitem.select(
        "l_orderkey", F.col("l_shipdate").cast("date").alias("date"),
        "l_quantity", "l_returnflag", "l_partkey",
    )
    lines, owner = dealt(lines, "l_orderkey"), dealt(owner, "o_orderkey")
    owned = lines.join(owner, lines["l_orderkey"] == owner["o_orderkey"])
    return (
        dealt(owned, "msno", "date")
        .groupBy("msno", "date")
        .agg(
            F.sum(F.col("l_quantity") * 3600).alias("total_secs"),
            F.count_if(F.col("l_returnflag") == "A").alias("num_25"),
            F.count_if(F.col("l_returnflag") == "N").alias("num_100"),
            F.countDistinct("l_partkey").alias("num_unq"),
        )
    )


def customer_members(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").cast("string").alias("msno"),
        F.col("c_nationkey").cast("long").alias("city"),
        F.floor(F.col("c_acctbal") / 100).cast("long").alias("bd"),
        F.col("c_mktsegment").alias("gender"),
        (F.col("c_custkey") % 7).cast("long").alias("registered_via"),
        (F.lit(19900101) + (F.col("c_custkey") % 14) * 100 + F.col("c_custkey") % 28).cast("long")
        .alias("registration_init_time"),
    )


def orders_study(spark: SparkSession, sf_dir: str, cfg: StudyConfig = ORDERS_STUDY) -> StudyInputs:
    orders = table(spark, sf_dir, "orders")
    pieces = usage_pieces(spark, f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet")
    return StudyInputs(
        orders_transactions(orders),
        orders_usage(orders, table(spark, sf_dir, "lineitem"), pieces),
        customer_members(table(spark, sf_dir, "customer")),
        cfg,
    )


def events_study(spark: SparkSession, sf_dir: str, cfg: StudyConfig = EVENTS_STUDY) -> StudyInputs:
    stream = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string").alias("msno")
    day = F.to_date("ts")
    plan = (F.lit(3) + F.col("event_id") % 5).cast("int")
    txn = stream.where(F.col("event_type").isin("purchase", "error")).select(
        user,
        (F.get_json_object("props", "$.k").cast("long") % 7).alias("payment_method_id"),
        plan.cast("long").alias("payment_plan_days"),
        F.round(F.col("value") * 100).cast("long").alias("plan_list_price"),
        F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100)).otherwise(F.lit(0))
        .cast("long").alias("actual_amount_paid"),
        (F.col("event_id") % 3 == 0).cast("long").alias("is_auto_renew"),
        day.alias("transaction_date"),
        F.date_add(day, plan).alias("membership_expire_date"),
        (F.col("event_type") == "error").cast("long").alias("is_cancel"),
    )
    usage = (
        stream.where(F.col("event_type").isin("view", "click"))
        .groupBy(user, day.alias("date"))
        .agg(
            F.sum(F.col("value") * 120).alias("total_secs"),
            F.count_if(F.col("event_type") == "view").alias("num_25"),
            F.count_if(F.col("event_type") == "click").alias("num_100"),
            F.countDistinct("props").alias("num_unq"),
        )
    )
    return StudyInputs(txn, usage, None, cfg)
