"""The streamed roll-up equals the batch aggregate, also for late files and replays."""

import pytest
from pyspark.sql import functions as F

from renewscope.config import StudyConfig
from renewscope.streaming import rollup
from renewscope.streaming.rollup import Manifest, batch_totals, compact, consolidate, current_totals, start_rollup

CFG = StudyConfig()
SCHEMA = "msno string, date date, total_secs double"


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "msno string, day string, total_secs double")
    df.select("msno", F.col("day").cast("date").alias("date"), "total_secs").coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch(spark, tmp_path):
    logs, target, progress = (f"{tmp_path}/{n}" for n in ("logs", "totals", "progress"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(logs)
    run = lambda: start_rollup(stream(), target, progress, CFG).awaitTermination()
    arrive(spark, logs, [("a", "2017-01-01", 5.0), ("a", "2017-01-01", 90000.0), ("b", "2017-01-02", -3.0)])
    run()
    # A very late day and a known day arrive afterwards, in two files.
    arrive(spark, logs, [("a", "2015-01-01", 1.5), ("a", "2017-01-01", 2.0)])
    arrive(spark, logs, [("c", "2017-02-01", None)])
    run()
    run()
    want = batch_totals(spark.read.schema(SCHEMA).parquet(logs), CFG)
    got = current_totals(spark, target)
    assert got.count() == want.count() == 4
    assert got.exceptAll(want.select(got.columns)).count() == 0
    assert spark.read.parquet(target).select("batch").distinct().count() == 3
    merged = consolidate(spark, target, f"{tmp_path}/merged")
    assert merged.exceptAll(got.select(merged.columns)).count() == 0


def test_replayed_batch_counts_once(spark, tmp_path):
    """A lost progress folder makes the stream start over: the same batches are written again."""
    logs, target = f"{tmp_path}/logs", f"{tmp_path}/totals"
    arrive(spark, logs, [("a", "2017-01-01", 5.0)])
    for progress in ("one", "two"):
        stream = spark.readStream.schema(SCHEMA).parquet(logs)
        start_rollup(stream, target, f"{tmp_path}/{progress}", CFG).awaitTermination()
    assert [tuple(r)[2:] for r in current_totals(spark, target).collect()] == [(5_000_000, 1)]


def totals(spark, day, secs):
    return batch_totals(spark.createDataFrame([("a", day, secs), ("b", "2017-01-01", 1.0)], "msno string, day string, total_secs double").select("msno", F.col("day").cast("date").alias("date"), "total_secs"), CFG)


def added_up(spark, target):
    return {(r["msno"], str(r["date"])): (r["d_micros"], r["d_rows"]) for r in current_totals(spark, target).collect()}


def test_levels_are_merged_and_stay_few(spark, tmp_path):
    target, manifest = str(tmp_path), Manifest(spark, str(tmp_path))
    for number in range(21):
        rollup.add_batch(spark, target, number, totals(spark, f"2017-01-{number % 3 + 1:02d}", 2.0))
        compact(spark, target, fan_out=3)
        parts = manifest.parts()
        assert all(sum(p[0] == level for p in parts) < 3 for level in range(4))
    # 21 = 2 * 9 + 3: two parts of nine batches, one of three.
    assert [(p[0], p[2] - p[1] + 1) for p in manifest.parts()] == [(1, 3), (2, 9), (2, 9)]
    assert added_up(spark, target)["b", "2017-01-01"] == (21_000_000, 21)
    assert len(current_totals(spark, target).inputFiles()) <= 3 * 4


def test_replays_after_a_merge_count_once(spark, tmp_path):
    target = str(tmp_path)
    for number in range(3):
        assert rollup.add_batch(spark, target, number, totals(spark, "2017-01-02", 2.0))
    assert rollup.add_batch(spark, target, 2, totals(spark, "2017-01-02", 2.0))  # still its own part
    before = added_up(spark, target)
    assert compact(spark, target, fan_out=3) == 1 and added_up(spark, target) == before
    assert not rollup.add_batch(spark, target, 1, totals(spark, "2017-01-02", 2.0)) and added_up(spark, target) == before


@pytest.mark.parametrize("lost_at", ["commit", "remove_path"])
def test_crash_between_merge_and_commit(spark, tmp_path, monkeypatch, lost_at):
    target = str(tmp_path)
    for number in range(3):
        rollup.add_batch(spark, target, number, totals(spark, "2017-01-02", 2.0))
    before = added_up(spark, target)

    def lost(*args):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(*((Manifest, "commit") if lost_at == "commit" else (rollup, "remove_path")), lost)
        with pytest.raises(RuntimeError):
            compact(spark, target, fan_out=3)
    assert added_up(spark, target) == before
    compact(spark, target, fan_out=3)
    assert added_up(spark, target) == before and [p[0] for p in Manifest(spark, target).parts()] == [1]


def test_no_batches(spark, tmp_path):
    assert current_totals(spark, str(tmp_path)).count() == 0 and compact(spark, str(tmp_path)) == 0
