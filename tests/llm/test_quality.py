import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from renewscope.llm import quality, quality_query, subword

SF = "/root/testdata/sf0.01"


def test_hashes_equal_plain_ones(monkeypatch):
    """The same words and n-grams have the same hashes wherever they stand, different ones differ."""
    texts = ["Größe of a word word", None, "", " a  Größe ", "日本 a"]
    got = {}
    for block in (1 << 18, 12):
        monkeypatch.setattr(subword, "_BLOCK", block)
        found = {}
        for kind, rows, hashes in subword.features(pa.array(texts), subword.SPACED, (3,), (2,), again=True):
            for r, h in zip(rows.tolist(), hashes.tolist()):
                found.setdefault((kind, r), []).append(h)
        got[block] = found
    words = lambda r: got[1 << 18].get((subword.WORDS, r), [])
    assert [len(words(r)) for r in range(5)] == [5, 0, 0, 2, 2]
    assert words(0)[0] == words(3)[1] and words(0)[2] == words(3)[0] == words(4)[1] and len(set(words(0))) == 4
    grams = got[1 << 18][(subword.GRAMS, 0)]
    assert len(grams) == 5 + 2 + 1 + 4 + 4 and len(set(grams)) == 12  # with a mark on either side of a word
    assert len(got[1 << 18][(subword.AGAIN, 0)]) == 1
    assert sorted(got[12][(subword.WORDS, 3)]) == sorted(words(3))


def test_held_out_accuracy(spark):
    found = quality_query.op3_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert (good.predicted == 1).mean() > 0.95 and (bad.predicted == 0).mean() > 0.8 and good.score.mean() > 0.9


def test_odd_rows(spark, odd_docs, no_docs, odd_labels):
    model = quality.train(odd_docs, odd_labels)
    got = odd_docs.select(quality.quality(spark, model, F.col("text")).alias("p")).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["p"] <= 1 for r in got)
    one = quality.train(odd_docs, odd_labels.where("label = 1"))
    assert {round(r[0], 6) for r in odd_docs.select(quality.quality(spark, one, F.col("text"))).collect()} == {round(1 - 1 / 6, 6)}
    assert np.isfinite(quality.train(no_docs, odd_labels)).all()
    assert no_docs.select(quality.quality(spark, model, F.col("text"))).count() == 0
