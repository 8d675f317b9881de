import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from renewscope.llm import ppm, ppm_query


def plain_bits(texts, text):
    """Code length with dictionaries of counts, one symbol after the other."""
    counts = defaultdict(lambda: defaultdict(int))
    frame = lambda t: [ppm.START] * ppm.ORDER + [b + 32 if 65 <= b <= 90 else b for b in t.encode()]
    for t in texts:
        s = frame(t)
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    s, bits = frame(text), 0.0
    for i in range(ppm.ORDER, len(s)):
        for k in range(ppm.ORDER, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = counts.get(tuple(s[i - k : i]))
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if s[i] in seen:
                bits -= math.log2(seen[s[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
    return bits


def test_code_lengths_equal_plain_counts(spark, monkeypatch):
    known = {"en": ["the cat sat on the mat", "The hat"], "de": ["die Katze saß", "der Hut"]}
    rows = [(i, t, l) for i, (l, t) in enumerate((l, t) for l, ts in known.items() for t in ts)]
    model = ppm.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["the dog", "saß der Kater?", "", "日本", "x" * 50]
    want = np.array([[plain_bits(known[l], t) for l in model.labels] for t in texts])
    assert model.labels == ["de", "en"]
    assert np.allclose(model.code_lengths(pa.array(texts)), want, atol=1e-3)
    monkeypatch.setattr(ppm, "_BLOCK", 7)  # long texts in parts
    assert np.allclose(model.code_lengths(pa.array(texts)), want, atol=1e-3)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = ppm_query.op1_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1


def test_odd_rows(spark, odd_docs, no_docs):
    model = ppm.train(odd_docs)
    assert model.labels == ["de", "en", "es"]
    got = odd_docs.select("doc_id", ppm.language(spark, model, F.col("text")).alias("x")).select("doc_id", "x.*").collect()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == odd_docs.count() and by[1] == by[2] == by[3] == "und" and by[9] == "es" and by[8] == "de"
    empty = ppm.train(no_docs)
    assert empty.labels == [] and no_docs.select(ppm.language(spark, model, F.col("text"))).count() == 0
    assert {r[0]["lang_pred"] for r in odd_docs.select(ppm.language(spark, empty, F.col("text"))).collect()} == {"und"}


def test_bounded_model_keeps_the_most_frequent_windows(spark, odd_docs):
    model = ppm.train(odd_docs, max_windows=50)
    assert len(model.maps[-1].values) <= 50
    assert np.isfinite(model.code_lengths(pa.array(["abc", "delta0 rho3"]))).all()


def test_a_small_language_keeps_its_share(spark):
    """A language of one per cent of the text, with more windows in all than the bound: it keeps its own, and short contexts stay exact."""
    rng = np.random.default_rng(3)
    words = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [(i, words("abcdefgh", 200), "large") for i in range(99)] + [(99, words("rstuvwxy", 200), "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every = {r["label"]: r["w"] for r in ppm.count_windows(docs).groupBy("label").agg(F.count("*").alias("w")).collect()}
    bound = 400
    assert every["small"] > bound / 2 and every["large"] > bound
    model, full = ppm.train(docs, max_windows=bound), ppm.train(docs)
    assert model.labels == full.labels == ["large", "small"]
    probe = pa.array([words("rstuvwxy", 5), words("abcdefgh", 5)])
    assert model.code_lengths(probe).argmin(axis=1).tolist() == [1, 0]
    for length in range(1, ppm.SHORT + 1):
        windows = np.unique(np.frombuffer("rstu vabc xyz".encode(), np.uint8).astype(np.uint64) * np.uint64(256 if length > 1 else 1) + np.uint64(ord("a") if length > 1 else 0))
        assert np.array_equal(model.costs(windows, length), full.costs(windows, length))
    longest = model.costs(np.zeros(0, np.uint64)).shape
    assert longest == (0, 2) and 0 < len(model.maps[-1].values) <= bound
