"""Vectors as arrow lists: which ones count, and as one matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles; there must be at least one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, also where squares would overflow or vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def runs(batches, keys: list[str]):
    """(first row's keys, table) of every run of rows with equal keys, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k))
            values = np.array(column.to_pylist(), dtype=object) if not pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            if held and _key(held[0], keys) != _key(part, keys):
                yield _key(held[0], keys), pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield _key(held[0], keys), pa.Table.from_batches(held)


def _key(batch: pa.RecordBatch, keys: list[str]) -> tuple:
    return tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
