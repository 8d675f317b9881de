import collections
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from renewscope.llm import covering, graph, simhash, simhash_query


def fingerprint(text, n=3):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_code_covers_each_vector_once():
    words = covering.code_words()
    assert min(int(w).bit_count() for w in words[1:]) == 7 and len(set(words.tolist())) == 4096
    at = np.arange(1 << 23, dtype=np.uint32)
    assert np.bitwise_count(at ^ words[covering.homes()]).max() == covering.RADIUS


def test_visits_are_the_anchors_within_reach():
    fp = np.random.default_rng(1).integers(0, 1 << 63, 20, dtype=np.uint64)
    row, anchor = covering.visited_anchors(fp, 2)
    for i, f in enumerate(fp.tolist()):
        near = {f} | {f ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)} | {f ^ (1 << a) for a in range(64)}
        want = set(covering.home_anchor(np.array(sorted(near), np.uint64)).tolist())
        got = anchor[row == i].tolist()
        assert set(got) == want and len(got) == len(want)


def test_links_equal_all_pairs(spark):
    random.seed(3)
    prints = set()
    for _ in range(60):
        f = random.getrandbits(64)
        prints.add(f)
        for _ in range(8):
            prints.add(f ^ sum(1 << b for b in random.sample(range(64), random.randint(1, 4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    got = sorted(tuple(sorted((r["a"] % (1 << 64), r["b"] % (1 << 64)))) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2).collect())
    every = sorted(prints)
    assert got == [(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if (a ^ b).bit_count() <= 2]


def test_visits_are_not_broadcast(spark):
    """A fingerprint has some 60 visits, which Spark's estimate of the table leaves out."""
    prints = spark.range(500).select(F.xxhash64("id").alias("fp"))
    visits = simhash.links(prints, 2)
    plan = visits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_kept_hashes_are_not_broadcast(odd_docs):
    plan = simhash.deduplicated(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan.split("LeftSemi")[0].splitlines()[-1]


def test_components_of_a_path_and_a_hub(spark):
    random.seed(5)
    ids = random.sample(range(10_000), 400)
    pairs = list(zip(ids[:150], ids[1:150])) + [(ids[200], x) for x in ids[201:300]] + [(ids[350], ids[350])]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups(pairs[:-1], {n for p in pairs[:-1] for n in p})
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(f"Wörd{i % 97} é" for i in range(2000)) + " " + "y" * 500 + " end"
    data = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(simhash, "_BYTES", 300)
    monkeypatch.setattr(simhash, "_SHINGLES", 7)
    assert simhash.fingerprint(data, 0, len(data), 3) == fingerprint(text)


def check(rows, distance=2):
    prints = {r["doc_id"]: [] for r in rows}
    for r in rows:
        prints[r["doc_id"]].append(r["fp"] % (1 << 64))
    every = sorted({r["fp"] % (1 << 64) for r in rows})
    root = groups([(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if (a ^ b).bit_count() <= distance], every)
    least = {}
    for r in rows:
        k = root[r["fp"] % (1 << 64)]
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    for r in rows:
        assert r["component_id"] == least.get(root[r["fp"] % (1 << 64)])


def test_documents_equal_brute_force(spark, sf_dir, documents):
    rows = simhash.near_duplicates(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all(fingerprint(texts[r["doc_id"]]) == r["fp"] % (1 << 64) for r in rows) and len(rows) == len(texts)
    check(rows)
    query = {r["doc_id"]: r for r in simhash_query.op5_simhash(spark, sf_dir).collect()}
    assert all(query[r["doc_id"]]["fingerprint"] == f"{r['fp'] % (1 << 64):016x}" for r in rows)


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check(rows)
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    got = collections.Counter(r["doc_id"] for r in kept.collect())
    # the null id's text is a group of its own; ids 1 to 3 have no words, 10 and 11 are copies
    assert got == collections.Counter([1, 4, 5, 6, 6, None, 7, 8, 9, 10])
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.deduplicated(no_docs).count() == 0


def test_null_texts_are_zero(spark):
    df = spark.createDataFrame([("",), (None,), (" \t",)], "text string").select(simhash.fingerprint_column(F.col("text")).alias("fp"))
    assert [r["fp"] for r in df.collect()] == [0, 0, 0]
