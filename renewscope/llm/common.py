"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewscope.session import through_table

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of the frame has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"__{stem}_{uuid.uuid4().hex[:8]}"
    return name


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def hash_share(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the given values only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


#: Classes that a model may have; more of them are an error, not a cut.
MAX_STRATA = 4096


def bounded_rows(df: DataFrame, key: Column, stratum: Column, weight: Column, budget: float) -> DataFrame:
    """Rows in hash order of their key, about `budget` of weight for each stratum (all of it where there is less).

    The strata's totals come from one aggregate over all rows; a row stays if its hash is
    below budget / total. The same rows stay however the table is partitioned.
    """
    rows = df.withColumn("__stratum", stratum.cast("string")).withColumn("__share", hash_share(key))
    totals = rows.groupBy("__stratum").agg(F.sum(weight.cast("double")).alias("total")).limit(MAX_STRATA + 1).collect()
    if len(totals) > MAX_STRATA:
        raise ValueError(f"over {MAX_STRATA} classes")
    shares = df.sparkSession.createDataFrame([(r[0], float(budget) / max(r[1] or 0.0, 1e-9)) for r in totals], "__of string, __kept double")
    kept = rows.join(F.broadcast(shares), F.col("__stratum").eqNullSafe(F.col("__of"))).where("__share < __kept")
    return kept.drop("__stratum", "__share", "__of", "__kept")


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """doc_id, text, label of about `max_rows` labelled documents a label, in hash order of the id, and
    of those about `max_bytes` bytes a label. Only the chosen ids, which `max_rows` bounds, are broadcast.

    `labels` has doc_id and label; rows with a null in either are left out; a null text is empty."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("label").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    ids = bounded_rows(known, F.col("id"), F.col("label"), F.lit(1), max_rows)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")
    rows = through_table(rows, "labelled")
    return bounded_rows(rows, F.col("doc_id"), F.col("label"), F.octet_length("text") + 1, max_bytes)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and its n + 1 offsets; a null has no bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def blocks(ends: np.ndarray, limit: int, data: np.ndarray | None = None, breaks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of (row, start, end) with at most about `limit` bytes each.

    A longer text is cut into several pieces, where `breaks` (by byte value) allows it if
    there is such a byte in the piece, so that memory does not grow with one text.
    """
    rows, starts, stops, size = [], [], [], 0
    for row in range(len(ends) - 1):
        at, end = int(ends[row]), int(ends[row + 1])
        while at < end:
            stop = min(end, at + limit - size)
            if stop < end:
                if size:  # a long text begins a block of its own
                    stop = at
                elif breaks is not None and data is not None:
                    found = np.flatnonzero(breaks[data[at:stop]])
                    stop = at + int(found[-1]) + 1 if len(found) else stop
            if stop > at:
                rows.append(row), starts.append(at), stops.append(stop)
                size += stop - at
                at = stop
            if at < end or size >= limit:
                yield np.array(rows), np.array(starts), np.array(stops)
                rows, starts, stops, size = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(starts), np.array(stops)


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given spans, one span after the other."""
    total = int(lengths.sum())
    steps = np.ones(total, np.int64)
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    heads = np.cumsum(lengths) - lengths
    if total:
        steps[heads] = starts - np.concatenate(([0], starts[:-1] + lengths[:-1] - 1))
    return np.cumsum(steps)


@lru_cache(maxsize=8)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(steps))
    return out[0], out[1]
