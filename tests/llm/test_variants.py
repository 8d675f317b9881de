"""Words and near words against plain Python over all pairs."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from renewscope.llm import variants as V


def plain_words(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            found[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(words):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_apart(a, b):
            near[a].append(b), near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def forms(spark, words):
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    return {tuple(r) for r in V.variant_forms(table).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_words_equal_plain_ones(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = {r["word"]: r["n"] for r in V.counted_words(documents).collect()}
    assert got == plain_words(rows) and len(got) > 1000


def test_forms_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "FREQUENT", 3)  # grams grow
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abé"), rng.integers(7, 11))) for _ in range(150)]
    words = {}
    for w in base:
        i, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
        for x in (w, w[:i] + "c" + w[i + (kind > 0) :], w[:i] + w[i + 1 :], "z" + w, w + "ÿ"):
            if len(x) >= 7:
                words[x] = int(rng.choice([2, 3, 25, 30, 400, 5000]))
    words |= {"x" * 3000: 2, "x" * 2999: 40, "x" * 2998: 900, "aaaaaaa": 2, "aaaaaaaa": 21, "aaaaaaab": 20}
    assert forms(spark, words) == plain_forms(words)


def test_chains_of_forms(spark):
    words = {"kettles" + "s" * i: 2 * 10**i for i in range(9)}
    got = {r[0]: r[2] for r in forms(spark, words)}
    assert set(got.values()) == {"kettles" + "s" * 8}


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=7, max_size=12), st.integers(0, 12), st.sampled_from("abcd"), st.sampled_from("idr"))
def test_no_edit_affects_both_grams(word, at, letter, kind):
    """Whatever the dictionary, an edited word holds a gram in a list that the word looks into."""
    import pyarrow as pa

    at = min(at, len(word) - (kind != "i"))
    other = word[:at] + {"i": letter, "d": "", "r": letter}[kind] + word[at + (kind != "i") :]
    if other == word or len(other) < 7:
        return
    a, b = sorted((word, other), key=len)
    grams = {2: (np.array(sorted(ord(x) << 8 | ord(y) for x in "ab" for y in "abc")), np.arange(6) + 1)}
    batch = lambda w: iter([pa.RecordBatch.from_arrays([pa.array([w]), pa.array([2])], ["word", "n"])])
    keys = lambda run, w: {k for part in run(batch(w)) for k in part.column(0).to_pylist()}
    assert keys(V._asked(grams), a) & keys(V._held(grams), b)


def test_odd_and_no_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    words = V.counted_words(odd_docs)
    assert {r["word"]: r["n"] for r in words.collect()} == plain_words(rows)
    assert V.variant_forms(words).count() == len(plain_words(rows))
    assert V.variant_forms(V.counted_words(no_docs)).count() == 0
