"""Stages that are written once, key-checked caches, sweep and result stores."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewscope.sources.raw import path_exists, remove_path, table_complete


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()) -> DataFrame:
    """Read a finished table, or build, write and read it. A table without its commit
    marker, left by a lost job, is built again."""
    if not table_complete(spark, path):
        writer = build().write.mode("overwrite").option("compression", "snappy")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def key_fingerprint(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count and order-free hash sums of the keys, as one row. Sums of 32-bit
    parts cannot overflow below 2^31 rows per part of the hash."""
    h = F.xxhash64(*keys)
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    total = lambda c: F.sum(c.cast("decimal(38,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), total(low).alias("low"), total(high).alias("high"))


def cached_by_keys(spark: SparkSession, path: str, keyed: DataFrame, keys: Sequence[str],
                   build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """Reuse a table only when it was built for exactly the current keys.

    Returns the table and whether the stored copy was used.
    """
    now = key_fingerprint(keyed, keys)
    mark = f"{path.rstrip('/')}_keys"
    if table_complete(spark, path) and table_complete(spark, mark):
        if spark.read.schema(now.schema).parquet(mark).first() == now.first():
            return spark.read.parquet(path), True
    remove_path(spark, mark)  # first, so that no mark outlives the table it was made for
    build().write.mode("overwrite").parquet(path)
    now.write.mode("overwrite").parquet(mark)
    return spark.read.parquet(path), False


class SweepStore:
    """Trial tables as Parquet with the best trial and notes beside them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, part: str) -> str:
        return f"{self.root}/{name}/{part}"

    def has(self, name: str) -> bool:
        return table_complete(self.spark, self._path(name, "summary"))

    def save(self, name: str, trials: DataFrame, params: Sequence[str], score: str = "macro_f1", **meta) -> None:
        """The summary goes first and is written last, so a sweep exists only when it is whole."""
        remove_path(self.spark, self._path(name, "summary"))
        trials.write.mode("overwrite").parquet(self._path(name, "trials"))
        best = trials.orderBy(F.desc(score), "trial").limit(1).select(
            F.lit(name).alias("name"), F.col(score).cast("double").alias("best_score"),
            F.to_json(F.struct(*params)).alias("best_params"), F.lit(json.dumps(meta)).alias("meta"))
        best.write.mode("overwrite").parquet(self._path(name, "summary"))

    def load(self, name: str) -> dict | None:
        """Best parameters, score and notes, or None when the sweep is not there."""
        if not self.has(name):
            return None
        row = self.spark.read.parquet(self._path(name, "summary")).first()
        return {"name": row["name"], "best_score": row["best_score"],
                "best_params": json.loads(row["best_params"]), "meta": json.loads(row["meta"])}

    def trials(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name, "trials"))


class TrialLedger:
    """One committed record a trial: a table of its own that counts once its commit marker is there.

    A driver that is lost between two trials finds all that were committed; a record that was
    begun is written again. Trials are numbered by their draw, so a rerun knows which are missing."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{name}"

    def _path(self, trial: int) -> str:
        return f"{self.root}/trial-{trial:06d}"

    def missing(self, n: int) -> list[int]:
        return [i for i in range(n) if not table_complete(self.spark, self._path(i))]

    def commit(self, trial: int, record: dict) -> None:
        self.spark.createDataFrame([record]).coalesce(1).write.mode("overwrite").parquet(self._path(trial))

    def records(self, n: int) -> DataFrame:
        """All committed trials; every one of the `n` must be there."""
        if lost := self.missing(n):
            raise ValueError(f"trials that aren't committed: {lost}")
        return self.spark.read.parquet(*[self._path(i) for i in range(n)])


def write_report(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header. Reports are summaries of bounded size, so
    one file is written; no event-level table may be passed here."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    if not path_exists(spark, path):
        return None
    return spark.read.option("header", True).schema(schema).csv(path)
