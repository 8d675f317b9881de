"""Raw files: CSV to Parquet, pruned reads, optional parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewscope.functions.scalar import parse_yyyymmdd
from renewscope.sources.schemas import DATASETS, TRUTH_LABELS


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    where, system = _opened(spark, path)
    return system.exists(where)


def _opened(spark: SparkSession, path: str):
    """A path and the file system that it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a folder; none if it isn't there."""
    where, system = _opened(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """Size of files or folders on whatever file system they are."""
    opened = [_opened(spark, p) for p in paths]
    return sum(system.getContentSummary(where).getLength() for where, system in opened)


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a path with all that lies below it, if it is there."""
    where, system = _opened(spark, path)
    system.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text on whatever file system the path names."""
    where, system = _opened(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    where, system = _opened(spark, path)
    size = system.getFileStatus(where).getLen()
    stream = system.open(where)
    try:
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()


def table_complete(spark: SparkSession, path: str) -> bool:
    """A table directory counts once its commit marker is there."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def convert_csv(spark: SparkSession, raw_dir: str, name: str, force: bool = False) -> str:
    """One CSV to Snappy Parquet with declared types and column order.

    Columns are matched by header name, so the file may order them differently. Returns
    'converted', 'skipped' (already there, with its commit marker) or 'missing'.
    """
    schema = DATASETS[name]
    source, target = f"{raw_dir}/{name}.csv", f"{raw_dir}/{name}.parquet"
    if not path_exists(spark, source):
        return "missing"
    if table_complete(spark, target) and not force:
        return "skipped"
    text = spark.read.option("header", True).csv(source)
    absent = [c for c in schema.names if c not in text.columns]
    if absent:
        raise ValueError(f"{name}.csv lacks columns {absent}")
    typed = text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    typed.write.mode("overwrite").option("compression", "snappy").parquet(target)
    return "converted"


def convert_all(spark: SparkSession, raw_dir: str, only: Sequence[str] | None = None,
                force: bool = False) -> dict[str, str]:
    """Convert each dataset; a failing or missing one does not stop the others."""
    unknown = [n for n in only or () if n not in DATASETS]
    if unknown:
        raise ValueError(f"unknown datasets {unknown}")
    report = {}
    for name in only or DATASETS:
        try:
            report[name] = convert_csv(spark, raw_dir, name, force)
        except Exception as exc:  # noqa: BLE001 - reported per dataset
            report[name] = f"failed: {str(exc).splitlines()[0]}"
    return report


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Pruned scan: only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def read_parts(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Union of the parts that exist."""
    found = [read_columns(spark, p, columns) for p in paths if path_exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"none of {list(paths)} exists")
    return reduce(DataFrame.unionByName, found)


def read_transactions(spark: SparkSession, raw_dir: str) -> DataFrame:
    parts = [f"{raw_dir}/{n}.parquet" for n in ("transactions", "transactions_v2")]
    raw = read_parts(spark, parts, DATASETS["transactions"].names)
    return raw.withColumns({c: parse_yyyymmdd(F.col(c)) for c in ("transaction_date", "membership_expire_date")})


def read_user_logs(spark: SparkSession, raw_dir: str) -> DataFrame:
    parts = [f"{raw_dir}/{n}.parquet" for n in ("user_logs", "user_logs_v2")]
    raw = read_parts(spark, parts, ["msno", "date", "num_25", "num_100", "num_unq", "total_secs"])
    return raw.withColumn("date", parse_yyyymmdd(F.col("date")))


def read_members(spark: SparkSession, raw_dir: str) -> DataFrame | None:
    path = f"{raw_dir}/members_v3.parquet"
    return read_columns(spark, path, DATASETS["members_v3"].names) if path_exists(spark, path) else None


def read_truth(spark: SparkSession, path: str) -> DataFrame | None:
    """Optional published labels."""
    if not path_exists(spark, path):
        return None
    return spark.read.option("header", True).schema(TRUTH_LABELS).csv(path)


def raw_study(spark: SparkSession, raw_dir: str, cfg):
    """The study inputs from converted raw files."""
    from renewscope.sources.adapters import StudyInputs

    return StudyInputs(read_transactions(spark, raw_dir), read_user_logs(spark, raw_dir),
                       read_members(spark, raw_dir), cfg)


def load_events(spark: SparkSession, path: str, columns: Sequence[str], modellable_only: bool = False) -> DataFrame:
    """Needed columns of the engineered table; the filter reaches the Parquet reader."""
    events = spark.read.parquet(path)
    if modellable_only:
        events = events.where(F.col("is_modellable") == 1)
    return events.select(*columns)
