import numpy as np
from pyspark.sql import functions as F

from renewscope.llm import toxicity, toxicity_query

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    found = toxicity_query.op6_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    bad, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert (bad.predicted == 1).mean() > 0.85 and (clean.predicted == 0).mean() > 0.95


def test_label_model_finds_accuracies_and_shares_weight():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.2
    fire = lambda toxic, clean: np.where(y, rng.random(6000) < toxic, rng.random(6000) < clean).astype(float)
    good, weak = fire(0.6, 0.01), fire(0.3, 0.2)
    votes = np.column_stack((good, good, good, fire(0.5, 0.02), weak))
    votes = np.column_stack((votes, votes.sum(axis=1) == 0))
    start = np.array([[0.02, 0.02, 0.02, 0.02, 0.2, 0.7], [0.5, 0.5, 0.5, 0.5, 0.3, 0.2]])
    known = np.where(np.arange(6000) < 1500, y.astype(int), -1)
    model = toxicity.fit_label_model(votes, known, start, 0.2)
    assert np.allclose(model.weights[:3], 1 / 3, atol=0.05) and model.weights[3] > 0.9
    assert abs(model.fires[1, 0] - 0.6) < 0.2 and model.fires[1, 3] > 10 * model.fires[0, 3]
    assert model.fires[1, 4] / model.fires[0, 4] < 5 < model.fires[1, 3] / model.fires[0, 3]


def test_copies_don_t_make_entries(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{base} tail{i}", 1) for i in range(20)] + [(100 + i, " ".join(f"v{i * j % 37}{j}" for j in range(30)) + " nasty", i % 2) for i in range(60)]
    kept = toxicity.distinct_texts(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sum(i < 100 for i in ids) == 1 and sum(i >= 100 for i in ids) > 30


def test_dense_entries():
    long = "nasty " + "word " * 500
    assert {"nasty", "nast*"} <= toxicity.entries(long) and "nasty@" not in toxicity.entries(long)
    assert "nasty@" in toxicity.entries("a nasty text") and toxicity.entries("") == set()


def test_odd_rows(spark, odd_docs, no_docs, odd_labels):
    model = toxicity.train(odd_docs, odd_labels)
    got = odd_docs.select(toxicity.toxicity(spark, model, F.col("text")).alias("p")).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["p"] <= 1 for r in got)
    for docs, labels in ((no_docs, odd_labels), (odd_docs, odd_labels.limit(0)), (no_docs, odd_labels.limit(0))):
        model = toxicity.train(docs, labels)
        assert docs.select(toxicity.toxicity(spark, model, F.col("text"))).count() == docs.count()
