"""Embedding near-duplicates by a pivot-permutation index.

Pivots are reference points from a bounded sample, no two of them near each other. A vector
is described by its nearest pivots in order. Inverted lists, one a label and pivot, hold the
vectors that have the pivot among them; two vectors of a list that share enough pivots
are verified by their cosine in double precision, each pair at its first shared pivot only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewscope.llm.graph import components
from renewscope.llm.vectors import matrix, runs, unit, usable
from renewscope.operators.skew import join_unique
from renewscope.session import through_table

#: Pivots by the number of vectors, 4 * sqrt(n), within bounds; pivots nearer to each other than this are thinned.
PIVOTS, APART = (64, 4096), 0.7
#: Nearest pivots that describe a vector, and how many of them a pair must share.
DESCRIBED, SHARED = 8, 2
#: Vectors of a list that are compared in one go; longer lists are cut into blocks, all pairs of which are compared.
BLOCK = 256


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Unit pivots: the vectors of the smallest hashes, without those near an earlier one."""
    count = int(min(max(4 * math.sqrt(n), PIVOTS[0]), PIVOTS[1]))
    rows = vectors.select("vector_key", "vector").orderBy(F.xxhash64("vector_key"), "vector_key").limit(count).toArrow()
    kept: list[np.ndarray] = []
    for row in unit(matrix(rows.column("vector"))) if rows.num_rows else []:
        if not kept or (np.array(kept) @ row).max() < APART:
            kept.append(row)
    return np.array(kept)


def _verify(vectors: np.ndarray, described: np.ndarray, sides: np.ndarray, pivot: int, shared: int, least: float) -> np.ndarray:
    """Which pairs of a block link here: near enough, enough shared pivots, and this one the first of them."""
    numbers, at = np.unique(described, return_inverse=True)
    marks = np.zeros((len(vectors), len(numbers)), np.float32)
    np.put_along_axis(marks, at.reshape(described.shape), 1, axis=1)
    earlier = marks[:, numbers < pivot]
    link = (vectors @ vectors.T >= least) & (marks @ marks.T >= shared) & (earlier @ earlier.T == 0)
    if sides.any() and not sides.all():  # two blocks: pairs across only, the others are compared elsewhere
        link &= sides[:, None] != sides[None, :]
    np.fill_diagonal(link, False)
    return link


def _smallest_reachable(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component in a block."""
    best = ids.copy()
    while True:
        near = np.where(link, best[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(best, near)
        if (new == best).all():
            return best
        best = new


def near_duplicates(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", label: str = "label", vector: str = "embedding",
                    described: int = DESCRIBED, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Only vectors with equal labels that aren't null, and of equal length, are compared. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows without an id, link
    with nothing: 0 links and a component of their own. Copies of a vector are looked for once
    and counted as links of each other; a row that is repeated with its id counts once as a
    link. An empty table gives none; other columns are not looked at.

    A list that holds a third of all rows is cut into blocks, and each pair of blocks is a
    task's group of its own. What leaves a block is, for each vector, its number of links and the
    smallest vector of its component there: no pairs, however dense the block.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    good = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    named = F.concat(F.hex(F.xxhash64("label", "vector")), F.hex(F.xxhash64("vector", F.lit(1), "label")))
    rows = through_table(rows.select("vec_id", "label", F.when(good, F.col("vector")).alias("vector"), F.when(good, named).alias("vector_key")), "vectors")
    copies = rows.where("vector_key IS NOT NULL").select("vec_id", "vector_key").distinct().groupBy("vector_key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    firsts = rows.where("vector_key IS NOT NULL").join(copies, "vector_key").where("vec_id = first").dropDuplicates(["vector_key"])
    firsts = through_table(firsts.select("vector_key", "label", F.size("vector").alias("dim"), "first", "copies", "vector"), "vector-firsts")
    found = None
    for dim in sorted(r["dim"] for r in firsts.select("dim").distinct().collect()):
        one = _links_of(firsts.where(F.col("dim") == dim), least, described, shared, block)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = through_table(found, "vector-links")
    roots = components(found.select(F.col("first").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("first").agg(F.sum("n").alias("n"))
    each = firsts.select("vector_key", "first", "copies").join(counts, "first", "left").join(roots, F.col("first") == F.col("node"), "left")
    each = through_table(each.select("vector_key", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "first").alias("component_id")), "vector-groups")
    known = join_unique(rows.where("vector_key IS NOT NULL").select("vec_id", "vector_key"), each, ["vector_key"], "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector_key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links_of(firsts: DataFrame, least: float, described: int, shared: int, block: int) -> DataFrame:
    """first, n, root: links of each vector and the smallest of its component, by block."""
    spark = firsts.sparkSession
    pivots = choose_pivots(firsts, firsts.count())
    k = min(described, len(pivots))
    shared = min(shared, k)
    lists = k - shared + 1  # in order of pivot numbers, a pair's first shared pivot is among these of both
    table = spark.sparkContext.broadcast(pivots)  # at most PIVOTS[1] vectors

    def describe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(-(unit(matrix(batch.column(3))) @ table.value.T), axis=1, kind="stable")[:, :k].astype(np.int32)
            size = np.full(batch.num_rows + 1, k).cumsum().astype(np.int32) - k
            permutation = pa.ListArray.from_arrays(pa.array(size), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, permutation], ["label", "first", "copies", "vector", "permutation"])

    index = firsts.select("label", "first", "copies", "vector").mapInArrow(describe, "label string, first long, copies long, vector array<double>, permutation array<int>")
    index = through_table(index, "pivot-index")
    postings = index.withColumn("pivot", F.explode(F.slice(F.array_sort("permutation"), 1, lists)))
    # Lists of one block need nothing; the others are few, and Spark broadcasts them if they are small.
    long = postings.groupBy("label", "pivot").agg(F.count("*").alias("n")).where(F.col("n") > block)
    long = through_table(long.select("label", "pivot", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "pivot-lists")
    postings = postings.join(long, ["label", "pivot"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int")
    postings = postings.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    postings = postings.select("label", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "first", "copies", "vector", "permutation")
    keys = ["label", "pivot", "i", "j"]

    def verify(batches):
        for (_, pivot, i, j), rows in runs(batches, keys):
            ids, copies = rows.column("first").to_numpy(), rows.column("copies").to_numpy()
            if len(ids) < 2:
                continue
            near = np.stack([np.asarray(x) for x in rows.column("permutation").to_numpy()]) if len(ids) else None
            sides = np.array(rows.column("side").to_pylist()) if i != j else np.zeros(len(ids), bool)
            if i != j and (sides.all() or not sides.any()):
                continue  # one of the two blocks is empty
            link = _verify(unit(matrix(rows.column("vector"))), near, sides, pivot, shared, least)
            at = np.flatnonzero(link.any(axis=1))
            if len(at):
                n = link[at] @ copies
                root = _smallest_reachable(link[np.ix_(at, at)], ids[at])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n.astype(np.int64)), pa.array(root)], ["first", "n", "root"])

    return postings.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "first long, n long, root long")
