"""Session defaults and the shared folder for cut lineages."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("renewscope")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RENEWSCOPE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder named by spark.checkpoint.dir.

    Where that setting is absent, a session in one process (unit tests) gets a temporary
    folder; a cluster gets an error, as its machines would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="renewscope-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and
    survives the loss of executors, unlike a cached or local copy."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
