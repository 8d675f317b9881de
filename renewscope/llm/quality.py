"""Quality classifier: supervised subword embeddings.

Words, character n-grams and the mark of a word said again are hashed into buckets, each bucket has a learned vector, a
document is the mean of its features' vectors, and a softmax layer gives the classes. Both
layers are trained together by stochastic gradient descent in numpy on a bounded sample of
labelled rows. Scoring takes the product of both layers, one number a bucket and class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewscope.llm.common import labelled_rows
from renewscope.llm.subword import SPACED, features

SIZES = (3, 4)
BUCKET_BITS, DIMENSION = 17, 16
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Labelled rows a class, and their bytes, that the vectors are trained on, in hash order of the id.
TRAIN_ROWS, TRAIN_BYTES = 2_500, 6_000_000


def _buckets(texts: pa.Array):
    for _, rows, hashes in features(texts, SPACED, SIZES, again=True):
        yield rows, (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def bags(docs: DataFrame) -> DataFrame:
    """label, buckets, counts of every row of (label, text)."""

    def counted(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 32):
                part = batch.slice(k, 32)
                keys = [r.astype(np.int64) << BUCKET_BITS | b for r, b in _buckets(part.column(1))]
                found, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                cuts = np.searchsorted(found >> BUCKET_BITS, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in ((found & ((1 << BUCKET_BITS) - 1)).astype(np.int32), n.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["label", "buckets", "counts"])

    return docs.mapInArrow(counted, "label int, buckets array<int>, counts array<float>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> np.ndarray:
    """Log odds of label 1 for each bucket, then the bias and the labels' log odds.

    Rows without a label are left out; null texts are empty. Without rows of both labels all
    texts get the share of label 1 (one half if there are none)."""
    sample = labelled_rows(docs, labels, max_rows, max_bytes)
    rows = bags(sample.orderBy("doc_id", "label", "text").select("label", "text")).toArrow()
    shares = {r["label"]: r["n"] for r in labels.where("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = np.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1))
    labels = rows.column("label").to_numpy()
    if len(set(labels.tolist())) < 2:
        return np.concatenate([np.zeros(1 << BUCKET_BITS), [0.0, prior]]).astype(np.float32)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (1 << BUCKET_BITS, DIMENSION)).astype(np.float32)
    out, bias = np.zeros((DIMENSION, 2), np.float32), np.zeros(2, np.float32)
    bucket_lists, count_lists = rows.column("buckets").combine_chunks(), rows.column("counts").combine_chunks()
    cuts = bucket_lists.offsets.to_numpy()
    all_buckets, all_counts = bucket_lists.values.to_numpy(), count_lists.values.to_numpy()
    of = [np.flatnonzero(labels == c) for c in (0, 1)]
    steps = EPOCHS * len(labels)
    for step in range(steps):  # classes take turns; the prior comes back below
        rate = RATE * (1 - step / steps)
        c = step & 1
        i = int(of[c][rng.integers(len(of[c]))])
        b, n = all_buckets[cuts[i] : cuts[i + 1]], all_counts[cuts[i] : cuts[i + 1]]
        if not len(b):
            continue
        weight = (n / n.sum()).astype(np.float32)
        mean = weight @ vectors[b]
        z = mean @ out + bias
        p = np.exp(z - z.max())
        error = p / p.sum()
        error[c] -= 1
        back = out @ error
        out -= rate * np.outer(mean, error)
        bias -= rate * 0.1 * error
        vectors[b] -= rate * len(b) ** 0.5 * weight[:, None] * back
    return np.concatenate([vectors @ (out[:, 1] - out[:, 0]), [bias[1] - bias[0], prior]]).astype(np.float32)


def quality(spark, model: np.ndarray, text: Column) -> Column:
    """Probability of label 1 of every whole text; a null or empty text has the labels' share."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** BUCKET_BITS numbers

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        model = shared.value
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for rows, buckets in _buckets(texts):
            total += np.bincount(rows, model[buckets], len(texts))
            n += np.bincount(rows, minlength=len(texts))
        z = np.where(n > 0, total / np.maximum(n, 1) + model[-2], 0.0) + model[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return scored(F.coalesce(text, F.lit("")))
