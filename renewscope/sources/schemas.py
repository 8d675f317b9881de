"""Schemas of the raw inputs."""

from pyspark.sql import types as T

# Column names, order and types of the raw files.
_TRANSACTION_FIELDS = (
    "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid",
    "is_auto_renew", "transaction_date", "membership_expire_date", "is_cancel",
)
_USAGE_FIELDS = ("date", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq")


def _longs(names) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


_USER = T.StructField("msno", T.StringType())

TRANSACTIONS = T.StructType([_USER, *_longs(_TRANSACTION_FIELDS)])
USER_LOGS = T.StructType([_USER, *_longs(_USAGE_FIELDS), T.StructField("total_secs", T.DoubleType())])
MEMBERS = T.StructType([
    _USER, *_longs(["city", "bd"]), T.StructField("gender", T.StringType()),
    *_longs(["registered_via", "registration_init_time"]),
])
TRUTH_LABELS = T.StructType([_USER, T.StructField("is_churn", T.IntegerType())])

# Dataset names of the raw folder.
DATASETS: dict[str, T.StructType] = {
    "members_v3": MEMBERS,
    "transactions": TRANSACTIONS,
    "transactions_v2": TRANSACTIONS,
    "user_logs": USER_LOGS,
    "user_logs_v2": USER_LOGS,
}

# Transaction columns in the order that breaks ties between rows of one day.
TXN_TIE_ORDER = (
    "actual_amount_paid", "plan_list_price", "is_cancel", "is_auto_renew",
    "payment_plan_days", "payment_method_id",
)
