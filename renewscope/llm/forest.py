"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree turns a vector into a long string of bits (signs of random projections) and keeps
its vectors in an array sorted by these strings. A query descends every tree to the vectors
that share the longest prefix with its own string, then all trees ascend together, one bit at
a time, until enough candidates are found; candidates are ranked by exact inner product.

Largest inner product is turned into largest cosine first: vectors get one more component
that makes them all as long as the longest one, and queries a zero there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewscope.llm.vectors import matrix, runs, unit, usable
from renewscope.session import through_table

#: Trees, bits of a string, and candidates a query looks at, copies in several trees counted, as a share of
#: the vectors. Unclustered vectors need many: the neighbours of such a vector are hardly nearer than the rest.
TREES, BITS, CANDIDATES, SEED = 16, 48, 1.5, 5
#: Shards of the index: so many at least, and of so many bytes (as doubles) at most; queries of one block.
SHARDS, SHARD_BYTES, QUERY_BYTES = 8, 1 << 26, 1 << 24


def _planes(dim: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, trees * bits))


def strings(points: np.ndarray, planes: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Bit strings as integers, one row a tree."""
    out = np.zeros((trees, len(points)), np.uint64)
    for at in range(0, len(points), 4096):
        signs = (points[at : at + 4096] @ planes > 0).reshape(-1, trees, bits)
        for b in range(bits):
            out[:, at : at + 4096] |= signs[:, :, b].T.astype(np.uint64) << np.uint64(bits - 1 - b)
    return out


class Forest:
    """Sorted arrays of the strings of one shard's vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int, bits: int):
        self.bits, self.trees = bits, trees
        spare = np.sqrt(np.maximum(longest**2 - (vectors * vectors).sum(axis=1), 0.0))
        self.planes = _planes(vectors.shape[1] + 1, trees, bits)
        keys = strings(np.column_stack((vectors, spare)), self.planes, trees, bits)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def ranges(self, queries: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in each tree's array, for each query, after the ascent that all trees make
        together: the longest prefix at which they hold `least` vectors in sum, or no prefix at all."""
        own = strings(np.column_stack((queries, np.zeros(len(queries)))), self.planes, self.trees, self.bits)
        first, last = np.zeros((self.trees, len(queries)), np.int64), np.zeros((self.trees, len(queries)), np.int64)
        # Longer prefixes hold fewer vectors, so the length is found by halving.
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), self.bits)
        while (low < high).any():
            middle = (low + high + 1) // 2
            a, b = self._at(own, middle)
            enough = (b - a).sum(axis=0) >= least
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        first, last = self._at(own, low)
        return first, last

    def _at(self, own: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = (self.bits - length).astype(np.uint64)
        start = own >> rest << rest
        end = start + (np.uint64(1) << rest)
        return tuple(np.stack([np.searchsorted(k, x) for k, x in zip(self.keys, side)]) for side in (start, end))

    def nearest(self, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, least: int):
        """For each query its `k` best candidates: (query row, vector row, inner product)."""
        first, last = self.ranges(queries, least)
        out_q, out_v, out_s = [], [], []
        # Queries that share all ranges are looked at together.
        places = np.concatenate((first, last)).T
        _, group = np.unique(places, axis=0, return_inverse=True)
        group = group.ravel()
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            q = part[0]
            mark = np.zeros(len(vectors), bool)
            for t in range(self.trees):
                mark[self.order[t, first[t, q] : last[t, q]]] = True
            found = np.flatnonzero(mark)
            scores = queries[part] @ vectors[found].T
            scores[query_ids[part][:, None] == ids[found][None, :]] = -np.inf
            for row, s in zip(part.tolist(), scores):
                best = self._best(s, ids[found], k)
                out_q.append(np.full(len(best), row)), out_v.append(found[best]), out_s.append(s[best])
        if not out_q:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)

    @staticmethod
    def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Places of the k largest scores, ties to the smaller id; all that tie with the last one are looked at."""
        if len(scores) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            at = np.flatnonzero(scores >= edge)
        else:
            at = np.arange(len(scores))
        at = at[np.isfinite(scores[at])]
        return at[np.lexsort((ids[at], -scores[at]))][:k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            trees: int = TREES, bits: int = BITS, candidates: float = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k vectors of largest inner product that were found.

    A query's own row (equal id) is no candidate; ties go to the smaller id; fewer candidates give
    fewer rows. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without an id, take no part; vectors are compared with those of their own length only; a
    row that is repeated counts once. Other columns are not looked at.

    The index is split into shards by a hash of the id, each a forest of its own over all trees,
    and queries into blocks; every block meets every shard, so no shard or block grows with the
    data. Each shard's ascent stops at its part of the candidates. With fewer vectors than k
    in a shard all of them are candidates.
    """
    shape = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = through_table(shape(vectors).withColumn("dim", F.size("vector")), "forest-rows")
    asked = through_table(shape(queries).dropDuplicates(["id", "vector"]).withColumn("dim", F.size("vector")), "forest-queries")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("longest")).join(asked.groupBy("dim").agg(F.count("*").alias("asked")), "dim")
    shards = F.greatest(F.lit(SHARDS), F.ceil(F.col("n") * F.col("dim") * 8 / SHARD_BYTES)).cast("int")
    blocks = F.ceil(F.col("asked") * F.col("dim") * 8 / QUERY_BYTES).cast("int")
    sizes = through_table(sizes.select("dim", "longest", shards.alias("shards"), blocks.alias("blocks")), "forest-sizes")
    index = rows.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ask = asked.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    ask = ask.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    columns = ["dim", "shard", "block", "longest", "id", "vector"]
    keys = ["dim", "shard", "block"]
    both = index.select(*columns, F.lit(0).alias("asks")).unionByName(ask.select(*columns, F.lit(1).alias("asks")))

    def search(batches):
        for _, group in runs(batches, keys):
            asks = group.column("asks").to_numpy()
            split = int(np.searchsorted(asks, 1))
            ids, points = group.column("id").to_numpy(), matrix(group.column("vector"))
            own, vector_rows = np.unique(ids[:split], return_index=True)
            if not len(own) or split == len(ids):
                continue
            here, there = points[:split][vector_rows], points[split:]
            longest = group.column("longest")[0].as_py()
            # Directions only: a common factor changes no sign.
            forest = Forest(here / longest, 1.0, trees, bits)
            least = max(k + 1, int(candidates * len(own)))
            q, v, s = forest.nearest(here, own, there, ids[split:], k, least)
            # The measure itself is a sum over components, the same in every block.
            exact = (there[q] * here[v]).sum(axis=1) if len(q) else s
            yield pa.RecordBatch.from_arrays([pa.array(ids[split:][q]), pa.array(own[v]), pa.array(exact)], ["query_id", "vec_id", "score"])

    found = both.repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
