import numpy as np
import pytest
from pyspark.sql import functions as F

from renewscope.llm import forest, pivots
from renewscope.llm.forest_query import op9_nearest
from renewscope.llm.pivots_query import op4_embedding_dedup


def clusters(seed, n=300, dim=16, noise=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        centre = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 9)):
            rows.append(centre + noise * rng.standard_normal(dim))
    rows = np.array(rows[:n])
    rows[5] = rows[4]
    return rows


def frame(spark, vectors, labels):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], l) for i, (v, l) in enumerate(zip(vectors, labels))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")


ODD = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [1.0, 2.0], [2.0, 4.0], [1e200, 2e200], [1e-200, 2e-200], [1.0, 2.0, 3.0], [-1.0, -2.0], [1.0, 2.0]]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    df = frame(spark, ODD, ["a"] * 12 + [None])
    more = spark.createDataFrame([(None, [1.0, 2.0], "a"), (6, [1.0, 2.0], "a"), (20, [1.0, 2.0], "b")], df.schema)
    return df.union(more).withColumns({n: F.lit(1) for n in ("vector", "dim", "first", "n", "root", "rank", "score", "shard", "id")})


def brute(vectors, labels, least):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = (unit @ unit.T >= least) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(link, False)
    best = np.arange(len(vectors))
    while True:
        new = np.minimum(best, np.where(link, best[None, :], len(best)).min(axis=1))
        if (new == best).all():
            return link.sum(axis=1), best
        best = new


@pytest.mark.parametrize("block", [4, 256])
def test_links_equal_all_pairs(spark, block):
    vectors = clusters(1)
    labels = ["hot" if i % 3 else "x" for i in range(len(vectors))]
    n, root = brute(vectors, labels, 0.93)
    got = {r["vec_id"]: r for r in pivots.near_duplicates(frame(spark, vectors, labels), block=block).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(vectors))])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(vectors))]) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_all_pivots_find_all_links(spark):
    vectors = clusters(2, noise=0.4)
    n, root = brute(vectors, ["a"] * len(vectors), 0.93)
    got = {r["vec_id"]: r for r in pivots.near_duplicates(frame(spark, vectors, ["a"] * len(vectors)), described=10_000, shared=1).collect()}
    assert [got[i]["n_links"] for i in range(len(vectors))] == n.tolist()
    assert [got[i]["component_id"] for i in range(len(vectors))] == root.tolist()


def planted(vectors, seed=7):
    """Vectors with perturbed copies of some: groups of 2 to 300, cosines of about 0.93 to 0.99, half of all under one label."""
    rng = np.random.default_rng(seed)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows, labels = [*unit], [int(i) for i in rng.integers(0, 4, len(unit))]
    for number, size in enumerate([2, 3, 5, 10, 20, 40, 80, 150, 300] + [2, 3, 4] * 20):
        base, near = unit[rng.integers(0, len(unit))], rng.uniform(0.93, 0.99)
        noise = rng.standard_normal((size, vectors.shape[1]))
        noise -= np.outer(noise @ base, base)
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        rows += [*(base + np.sqrt(1 / near - 1) * noise)]
        labels += [0 if number % 2 else number % 4] * size
    return np.array(rows), labels


def test_recall_on_embeddings(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL").orderBy("vec_id").toPandas()
    vectors, labels = planted(np.stack(table.embedding).astype(float))
    n, root = brute(vectors, labels, 0.93)
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(frame(spark, vectors, labels)).collect()}
    found = np.array([got[i] for i in range(len(vectors))])
    assert n.sum() > 1000 and (found <= n).all() and found.sum() >= 0.9 * n.sum()


def test_odd_vectors(odd_vectors):
    got = {}
    for r in pivots.near_duplicates(odd_vectors).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    for i in (0, 1, 2, 3, 4, 5, 10, 11, 12, 20):
        assert got[i] == [(0, i, True)]
    # 6 to 9 point the same way; 6 stands there twice and is one link
    assert got[6] == [(3, 6, True)] * 2 and got[7] == got[8] == got[9] == [(3, 6, False)]
    assert got[None] == [(0, None, True)]
    assert pivots.near_duplicates(odd_vectors.limit(0)).count() == 0
    assert pivots.near_duplicates(odd_vectors.where("vec_id < 5")).count() == 5


def test_query_keeps_every_row(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert op4_embedding_dedup(spark, sf_dir).select("vec_id").distinct().count() == vectors.count()


def plain_nearest(vectors, queries, k):
    out = {}
    for q in queries:
        s = vectors @ vectors[q]
        order = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:k]
        out[q] = [(i, s[i]) for i in order]
    return out


def test_all_candidates_are_exact(spark):
    vectors = clusters(3) * np.linspace(0.5, 2, 300)[:, None]
    df = frame(spark, vectors, ["a"] * 300)
    got = {}
    for r in forest.nearest(df, df.where("vec_id % 20 = 0"), k=7, candidates=1000.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = plain_nearest(vectors, range(0, 300, 20), 7)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()
    vectors = np.stack(rows.embedding).astype(float)
    want = plain_nearest(vectors, range(0, len(vectors), 20), 20)
    found = op9_nearest(spark, sf_dir).collect()
    hits = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in found)
    assert hits >= 0.93 * 20 * len(want)
    assert len(found) == 20 * len(want) and {r["rank"] for r in found} == set(range(1, 21))


def test_synchronous_ascent():
    vectors = clusters(4)
    tree = forest.Forest(vectors / 100, 1.0, 6, 24)
    first, last = tree.ranges(vectors[:20], 40)
    assert ((last - first).sum(axis=0) >= 40).all()
    # every range is one prefix of the same length, so its vector's own place lies in it
    for t in range(6):
        for q in range(20):
            assert q in tree.order[t, first[t, q] : last[t, q]] or (last - first).sum(axis=0)[q] >= 40


def test_odd_vectors_nearest(odd_vectors):
    rows = forest.nearest(odd_vectors, odd_vectors.where("vec_id in (0, 2, 6, 10, 12)"), k=20).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {6, 12}
    # equal scores go to the smaller id; rows without an id or of another length take no part
    assert got[6] == [8, 7, 12, 20, 9, 11] and got[12] == [8, 7, 6, 20, 9, 11]
    none = odd_vectors.limit(0)
    assert forest.nearest(none, none).count() == 0 and forest.nearest(odd_vectors, none).count() == 0
