"""The audit against a plain walk of every document through every order."""

import re
from collections import Counter
from itertools import permutations

from renewscope.llm import filter_audit as A


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, source in rows:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        told = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", body)) > 5 * len(body),
                "D": bool(re.search(r"[#$%&*|]", body)), "E": i is not None and first[body] < i}
        fails.append((source or "", {f for f in told if told[f]}, i in good, i in toxic))
    count, total = Counter(), Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, bad, is_good, is_toxic in fails:
            gone = False
            for step, f in enumerate(order, 1):
                count[part, order, step, "kept"] += not gone and f not in bad
                count[part, order, step, "removed"] += not gone and f in bad
                count[part, order, step, "redundant"] += gone and f in bad
                count[part, order, step, "unique_fails"] += bad == {f}
                count[part, order, step, "good_lost"] += not gone and f in bad and is_good
                count[part, order, step, "toxic_lost"] += not gone and f in bad and is_toxic
                total[part, f] += not gone and f in bad
                gone = gone or f in bad
    return {(p, o, s, *[count[p, o, s, c] for c in A.COUNTS], total[p, o[s - 1]])
            for p in {f[0] for f in fails} for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}


def audited(docs, labels):
    found = A.audit(A.failure_masks(docs, labels)).select("part", "filter_order", "step", *A.COUNTS, "shapley").collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def test_audit_equals_plain_walks(spark):
    plenty = " ".join(f"w{i}" for i in range(60))
    rows = [(1, plenty, "a"), (2, plenty, "a"), (2, plenty, "a"), (1, plenty, "b"), (None, plenty, "b"), (3, None, None), (4, "", ""), (5, "SHOUT # " * 40, "a"),
            (6, plenty.upper() + "|", "b"), (7, "same " * 70, None), (8, "same " * 70, "b"), (None, None, None), (9, "é" * 30 + "AB", "a")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (5, None, 1), (None, 1, 1), (7, 0, 0), (8, 1, None), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(docs, known) == plain_audit(rows, labels)


def test_odd_and_no_rows(spark, odd_docs, no_docs):
    known = spark.createDataFrame([(6, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text", "source").collect()]
    assert audited(odd_docs, known) == plain_audit(rows, [(6, 1, 1), (None, 1, 0)])
    assert audited(no_docs, known) == set()
    assert len(audited(odd_docs, known.limit(0))) == 600 * len({r[2] or "" for r in rows})
