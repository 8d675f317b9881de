"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree with frozen counts. The next byte costs
-log2 of its share after the longest context that holds it; each shorter step is paid by the
escape probability of the context left (method C: distinct / (total + distinct)); below the
empty context all 256 bytes are alike. A text's code length is the exact sum over all its
bytes, and the language with the shortest code wins.

As counts are frozen, a byte's cost depends on it and the `ORDER` bytes before it, so the
costs of all windows of a tree are worked out once and looked up for whole batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewscope.llm.common import blocks, bounded_rows, utf8
from renewscope.llm.hashtable import FrozenMap
from renewscope.session import through_table

ORDER = 4
#: What a language learns from: about so many bytes, in hash order; and windows that a model holds at most, an equal share a language.
TRAIN_BYTES, MAX_WINDOWS = 1_500_000, 1_000_000
#: Windows of up to so many bytes are counted exactly, whatever the share: 256 ** SHORT a language at most.
SHORT = 2
#: Stands before a text; no UTF-8 text has it.
START = 0xFF
_BLOCK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _framed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (context and byte) of the pieces, and where each piece's windows begin and end.

    `heads`: a piece begins its text; otherwise the bytes before it are its first context."""
    sizes = stops - starts + ORDER
    ends = np.cumsum(sizes)
    stream = np.full(int(ends[-1]), START, np.uint8)
    for start, stop, end, size, head in zip(starts.tolist(), stops.tolist(), ends.tolist(), sizes.tolist(), heads.tolist()):
        stream[end - size + ORDER : end] = data[start:stop]
        if not head:
            stream[end - size : end - size + ORDER] = data[start - ORDER : start]
    stream = _LOWER[stream]
    windows = np.zeros(len(stream) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        windows <<= np.uint64(8)
        windows |= stream[k : len(stream) - ORDER + k]
    return windows, ends - sizes, ends - ORDER


def _windows(texts: pa.Array):
    """(rows, windows, begins, ends) of parts of the texts, of bounded size."""
    data, ends = utf8(texts)
    for rows, starts, stops in blocks(ends, _BLOCK):
        # A piece that isn't the first of its text has at least ORDER bytes before it: blocks are longer.
        yield rows, *_framed(data, starts, stops, starts == ends[rows])


def count_windows(docs: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """label, window, n: how often each window of ORDER + 1 bytes occurs in the label's texts."""

    def counts(batches):
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in sorted(set(labels)):
                for _, windows, begins, ends in _windows(batch.column(1).filter(pa.array(labels == name))):
                    inside = np.zeros(len(windows) + 1, np.int32)
                    np.add.at(inside, begins, 1)
                    np.add.at(inside, ends, -1)
                    found, n = np.unique(windows[np.cumsum(inside[:-1]) > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(found.view(np.int64)), pa.array(n)], ["label", "window", "n"])

    counted = docs.select(F.col(label).cast("string"), F.col(text)).mapInArrow(counts, "label string, window long, n long")
    return counted.groupBy("label", "window").agg(F.sum("n").alias("n"))


class Model:
    """Frozen trees of all languages, as costs in bits of every window that any of them has seen.

    `whole` marks windows that count at all lengths; the others count only for their last SHORT bytes."""

    def __init__(self, labels: list[str], which: np.ndarray, windows: np.ndarray, counts: np.ndarray, whole: np.ndarray):
        self.labels = labels
        self.maps: list[FrozenMap] = []  # by length of the window
        self.escapes: list[FrozenMap | None] = []  # by length of the context
        shorter = np.full((1, len(labels)), 8.0, np.float32)  # any byte, below the empty context
        for length in range(1, ORDER + 2):
            here = whole | (length <= SHORT)
            kept = windows[here] & np.uint64((1 << 8 * length) - 1)
            keys, at = np.unique(kept, return_inverse=True)
            n = np.zeros((len(keys), len(labels)))
            np.add.at(n, (at, which[here]), counts[here])
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), len(labels))), np.zeros((len(contexts), len(labels)))
            np.add.at(total, of, n)
            np.add.at(distinct, of, n > 0)
            seen = total > 0
            weight = np.where(seen, total + distinct, 1.0)
            escape = np.where(seen, -np.log2(np.where(seen, distinct, 1.0) / weight), 0.0).astype(np.float32)
            below = shorter[np.zeros(len(keys), int)] if length == 1 else shorter[self.maps[-1].find(keys & np.uint64((1 << 8 * (length - 1)) - 1))]
            cost = np.where(n > 0, -np.log2(np.where(n > 0, n, 1.0) / weight[of]), escape[of] + below).astype(np.float32)
            self.maps.append(FrozenMap(keys, cost))
            self.escapes.append(FrozenMap(contexts, escape))
            shorter = cost

    def costs(self, windows: np.ndarray, length: int = ORDER + 1) -> np.ndarray:
        """Bits that the last byte of each window costs in each language."""
        if length == 0:
            return np.full((len(windows), len(self.labels)), 8.0, np.float32)
        row = self.maps[length - 1].find(windows)
        out = self.maps[length - 1].values[row] if len(self.maps[length - 1].values) else np.zeros((len(windows), len(self.labels)), np.float32)
        new = np.flatnonzero(row < 0)
        if len(new):
            context = self.escapes[length - 1].find(windows[new] >> np.uint64(8))
            paid = self.escapes[length - 1].values
            paid = np.where((context >= 0)[:, None], paid[context] if len(paid) else 0.0, 0.0)
            out[new] = paid + self.costs(windows[new] & np.uint64((1 << 8 * (length - 1)) - 1), length - 1)
        return out

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of every whole text in every language."""
        bits = np.zeros((len(texts), len(self.labels)))
        for rows, windows, begins, ends in _windows(texts):
            costs = self.costs(windows)
            edges = np.stack([begins, ends], axis=1).ravel()
            if edges[-1] == len(costs):
                costs = np.concatenate([costs, np.zeros((1, costs.shape[1]), np.float32)])
            np.add.at(bits, rows, np.add.reduceat(costs, edges, axis=0, dtype=np.float64)[::2])
        return bits


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
          train_bytes: int = TRAIN_BYTES, max_windows: int = MAX_WINDOWS) -> Model:
    """Trees from rows with text and label: about `train_bytes` bytes a label in hash order of the key, in
    Spark. Each label has an equal share of `max_windows`, one window at least, and its most frequent windows (ties to the
    smaller one) come to the driver; of the others only the sums by their last SHORT bytes do.

    Rows without text or label are left out; rows that are repeated, or have a null key, count each time;
    an empty table gives a model without languages. Other columns are not looked at."""
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    sample = bounded_rows(known, F.col("k"), F.col("label"), F.octet_length("text"), train_bytes)
    counted = through_table(count_windows(sample, "text", "label"), "windows")
    labels = sorted(r[0] for r in counted.select("label").distinct().collect())
    share = max(1, max_windows // max(1, len(labels)))
    # A label's windows are bounded by its training bytes.
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "window"))
    ranked = counted.withColumn("whole", place <= share)
    window = F.when(F.col("whole"), F.col("window")).otherwise(F.col("window").bitwiseAND(F.lit((1 << 8 * SHORT) - 1)))
    top = ranked.groupBy("label", "whole", window.alias("window")).agg(F.sum("n").alias("n")).toPandas()
    which = np.searchsorted(labels, top["label"]) if labels else np.zeros(0, int)
    return Model(labels, which, top["window"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.float64), top["whole"].to_numpy(bool))


def language(spark, model: Model, text: Column) -> Column:
    """struct(lang_pred, score): the cheapest language and its share of 2 ** -bits over all languages.

    Null texts, texts without a letter, and models without a language give und and 0; ties go to
    the first language by code point. Each row is looked at by itself, so repeated rows get equal results."""
    shared = spark.sparkContext.broadcast(model)  # at most max_windows rows a length of window, and 256 ** SHORT more a label
    labels = model.labels

    @F.arrow_udf("lang_pred string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        bits = shared.value.code_lengths(texts)
        best = bits.argmin(axis=1)
        odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0))
        return pa.StructArray.from_arrays([pa.array([labels[i] for i in best], pa.string()), pa.array(1.0 / odds.sum(axis=1))], ["lang_pred", "score"])

    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not labels:
        return none
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = predicted(F.when(lettered, text))
    return F.when(lettered, found).otherwise(none)
