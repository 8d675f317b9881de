"""Incremental usage totals per user and day from newly arrived log files.

Each micro-batch is reduced to one row per user and day and written to its own folder, named by the batch
number. Partial totals are additive; the current total is the sum of the live parts. What is live stands in a
manifest of which every version is a table of its own: a part counts once a committed version names it. When a
level has FAN_OUT parts they are merged into one of the next level and the next version names that in their
place, so that a reader meets no more than FAN_OUT parts a level and a day's totals are merged as often as there
are levels. A replayed batch is known by its number: it is written again where its part is still its own, and left
out where a merged part holds it. A crash leaves folders that no version names, which are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from renewscope.config import StudyConfig
from renewscope.functions.scalar import clip, to_micros
from renewscope.sources.raw import folder_names, remove_path, table_complete

PARTIAL = T.StructType([
    T.StructField("msno", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("d_micros", T.LongType()), T.StructField("d_rows", T.LongType()),
    T.StructField("batch", T.LongType()),
])


def batch_totals(logs: DataFrame, cfg: StudyConfig) -> DataFrame:
    secs = to_micros(clip(F.col("total_secs"), cfg.min_secs, cfg.max_secs))
    return logs.groupBy("msno", "date").agg(
        F.coalesce(F.sum(secs), F.lit(0).cast("long")).alias("d_micros"), F.count(F.lit(1)).alias("d_rows"))


#: Parts of a level that are merged into one of the next.
FAN_OUT = 4
_VERSION = "level int, first long, last long, path string"


class Manifest:
    """The live parts of a roll-up: level, first and last batch, folder below the target.

    Version k is the table `_manifest/v=k`; the highest one with its commit marker holds. One writer, the
    stream's driver, adds versions; the last few stay for readers that began with them."""

    def __init__(self, spark: SparkSession, target: str, keep: int = 8):
        self.spark, self.target, self.keep = spark, target.rstrip("/"), keep

    def _path(self, version: int) -> str:
        return f"{self.target}/_manifest/v={version}"

    def _of(self, version: int) -> list[tuple[int, int, int, str]]:
        if not table_complete(self.spark, self._path(version)):
            return []
        return sorted(tuple(r) for r in self.spark.read.schema(_VERSION).parquet(self._path(version)).collect())

    def version(self) -> int:
        """The highest committed version, 0 where there is none."""
        found = [int(n.partition("=")[2]) for n in folder_names(self.spark, f"{self.target}/_manifest") if n.startswith("v=")]
        return max((v for v in found if table_complete(self.spark, self._path(v))), default=0)

    def parts(self) -> list[tuple[int, int, int, str]]:
        return self._of(self.version())

    def commit(self, parts: list[tuple[int, int, int, str]]) -> None:
        """Add a version, and drop the one that is now too old with the parts that no later one names."""
        now = self.version() + 1
        self.spark.createDataFrame(parts, _VERSION).coalesce(1).write.mode("overwrite").parquet(self._path(now))
        old = now - self.keep
        for part in set(self._of(old)) - set(self._of(old + 1)):
            remove_path(self.spark, f"{self.target}/{part[3]}")
        remove_path(self.spark, self._path(old))

    def read(self, parts: list[tuple[int, int, int, str]]) -> DataFrame:
        """Totals over the given parts."""
        schema = T.StructType([f for f in PARTIAL if f.name != "batch"])
        if not parts:
            return self.spark.createDataFrame([], schema)
        partial = self.spark.read.schema(schema).parquet(*[f"{self.target}/{p}" for *_, p in parts])
        return partial.groupBy("msno", "date").agg(F.sum("d_micros").alias("d_micros"), F.sum("d_rows").alias("d_rows"))


def add_batch(spark: SparkSession, target: str, number: int, totals: DataFrame) -> bool:
    """Write a batch's totals and commit them; False where a merged part already holds this batch."""
    manifest = Manifest(spark, target)
    parts = manifest.parts()
    own = (0, number, number, f"batch={number}")
    if any(first <= number <= last for _, first, last, path in parts if path != own[3]):
        return False
    totals.write.mode("overwrite").parquet(f"{target}/{own[3]}")
    if own not in parts:
        manifest.commit([*parts, own])
    return True


def compact(spark: SparkSession, target: str, fan_out: int = FAN_OUT) -> int:
    """Merge full levels, lowest first, until none has `fan_out` parts; returns the number of merges.

    The merged part is written before the version that names it, and the folders it replaces go when
    the last version that names them does: a crash in between loses nothing and counts nothing twice."""
    manifest, merges = Manifest(spark, target), 0
    while True:
        parts = manifest.parts()
        full = [level for level in sorted({p[0] for p in parts}) if sum(p[0] == level for p in parts) >= fan_out]
        if not full:
            break
        old = [p for p in parts if p[0] == full[0]]
        first, last = min(p[1] for p in old), max(p[2] for p in old)
        merged = (full[0] + 1, first, last, f"_merged/level={full[0] + 1}/{first}-{last}")
        manifest.read(old).write.mode("overwrite").parquet(f"{target}/{merged[3]}")
        manifest.commit([*[p for p in parts if p not in old], merged])
        merges += 1
    return merges


def start_rollup(logs: DataFrame, target: str, checkpoint: str, cfg: StudyConfig, fan_out: int = FAN_OUT) -> StreamingQuery:
    """Process everything that has arrived, then stop; run again for later files."""

    def write(batch: DataFrame, number: int) -> None:
        add_batch(batch.sparkSession, target, number, batch_totals(batch, cfg))
        compact(batch.sparkSession, target, fan_out)

    return (
        logs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_totals(spark: SparkSession, target: str) -> DataFrame:
    """(msno, date) totals over all batches so far, from the live parts alone."""
    manifest = Manifest(spark, target)
    return manifest.read(manifest.parts())


def consolidate(spark: SparkSession, target: str, into: str) -> DataFrame:
    """Merge all partial totals into one table, for when there are many small batches."""
    current_totals(spark, target).write.mode("overwrite").parquet(into)
    return spark.read.parquet(into)
