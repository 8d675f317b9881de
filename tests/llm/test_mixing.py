import collections

import duckdb
import pytest
from pyspark.sql import functions as F

from renewscope.llm import mixing, mixing_query


def same(df, sql, **views):
    con = duckdb.connect()
    for name, frame in views.items():
        con.register(name, frame.toArrow())
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
    b = sorted(map(tuple, want.fetchall()), key=key)
    assert a == b


def test_rows_equal_sql(spark, sf_dir, documents):
    same(mixing_query.op2_mix_sources(spark, sf_dir), mixing_query.SQL, documents=documents)


def test_odd_rows_equal_sql(spark, odd_docs):
    mix = mixing.pareto_mix(odd_docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
    same(mix, mixing_query.SQL, documents=odd_docs.select("doc_id", "text", "source"))


def test_repeated_rows_at_the_cut_are_taken_one_by_one(spark):
    """Three ids of 60 copies each, parts of the table small: no source may pass its target by a group of copies."""
    docs = spark.range(1200, numPartitions=7).select(
        F.when(F.col("id") < 180, F.col("id") % 3).when(F.col("id") < 400, F.lit(None)).otherwise(F.col("id") % 90).alias("doc_id"),
        F.expr("repeat('w ', cast(5 + id % 3 as int))").alias("text"),
        F.when(F.col("id") < 180, "copies").when(F.col("id") < 400, "nulls").when(F.col("id") % 2 == 0, "rest").alias("source"))
    mix = mixing.pareto_mix(docs)
    same(mix.select("doc_id", "size", "source_size", "target", "taken", "copies"), mixing_query.SQL, documents=docs)
    per = mix.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert len(per) == 4 and all(abs(r["taken"] - r["target"]) <= r["most"] / 2 + 1e-9 for r in per)


def test_constant_of_a_source_with_capped_weights(spark):
    # Weights 8 and 1, 100 words each, target 500: 3 * 100 words of the first, the second twice
    sized = spark.createDataFrame([("a", 8, 100), ("a", 1, 60), ("a", 1, 40), ("b", 2, 0)], "source string, odds long, size long")
    targets = spark.createDataFrame([("a", 200, 500.0), ("b", 0, 0.0)], "source string, source_size long, target double")
    assert {r["source"]: r["constant"] for r in mixing.constants(sized, targets).collect()} == {"a": 2.0, "b": 0.0}
    full = targets.withColumn("target", F.lit(700.0))
    assert {r["source"]: r["constant"] for r in mixing.constants(sized, full).collect()}["a"] == float("inf")


def test_longer_documents_are_likelier(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', if(id % 2 = 0, 40, 5))").alias("text"), (F.col("id") % 4 < 2).cast("string").alias("source"))
    got = {(r[0], r[1]): r[2] for r in mixing.pareto_mix(docs).groupBy("source", "size").agg(F.avg("copies")).collect()}
    for source in ("true", "false"):  # six binary digits against three
        assert got[source, 40] == pytest.approx(2 * got[source, 5], rel=0.1)


def test_targets_stop_at_the_cap(spark):
    rows = [("a", 10), ("b", 1000), ("c", 30), (None, 5)]
    got = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size int")).collect()}
    # weights 1, 2, 3, 1 of 1045 words: a, c and the null source stop at three times their size
    assert got["a"]["target"] == 30 and got["c"]["target"] == 90 and got[None]["target"] == 15
    assert got["b"]["target"] == pytest.approx(1045 - 135)


def test_hot_source_comes_near_its_target(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 17 as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    per = mixing.pareto_mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 17 for r in per) and max(r["most"] for r in per) <= 3


def test_weights_are_inclusion_odds(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"),
                                    F.when(F.col("id") < 1500, 3.0).otherwise(1.0).alias("w"))
    got = mixing.pareto_mix(docs, weight="w").groupBy((F.col("doc_id") < 1500).alias("heavy")).agg(F.sum("copies").alias("n")).collect()
    n = {r["heavy"]: r["n"] for r in got}
    assert n[True] == pytest.approx(3 * n[False], rel=0.1) and n[True] + n[False] == pytest.approx(3000, abs=2)


def test_mixed_documents_repeat_whole_rows(odd_docs):
    plan = collections.Counter()
    for r in mixing.pareto_mix(odd_docs).collect():
        plan[(r["doc_id"], r["size"])] += r["copies"]
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    got = collections.Counter((r["doc_id"], len((r["text"] or "").split())) for r in mixed.collect())
    assert got == +plan


def test_empty(no_docs):
    assert mixing.pareto_mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
