"""Fingerprints against plain sums, edits against plain slices."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from renewscope.llm import fingerprints as P


def plain_mark(pieces):
    words = [0] * P.WORDS
    for piece in pieces:
        number = hashlib.sha256(piece.encode()).hexdigest()
        for j in range(4):
            h = int(number[16 * j : 16 * j + 16], 16)
            for k in range(32):
                words[32 * j + k] += (h >> k) & 1 | ((h >> k + 32) & 1) << 32
    return [*words, len(pieces)]


def lines(text):
    return [p for p in (text or "").split("\n") if p]


def plain_edits(rows):
    """(doc_id, text, edited) in descending order of the id, nulls last, texts of one id by digest."""
    digest = lambda i, t: hashlib.md5(f"{'null' if i is None else i}:{t}".encode()).hexdigest()
    docs = sorted(((i, t or "") for i, t in rows), key=lambda d: (d[0] is None, -(d[0] or 0), digest(*d)))
    out = []
    for at, (i, t) in enumerate(docs):
        third, after = len(t) // 3, docs[(at + 1) % len(docs)][1]
        out.append((i, t, t[: len(t) - third] + after[:third]))
    return out


def likeness(a, b):
    signs = lambda m: [2 * v - m[-1] for w in m[:-1] for v in (w & 0xFFFFFFFF, w >> 32)]
    x, y = signs(a), signs(b)
    both = sum(v * v for v in x) + sum(v * v for v in y)
    return 1.0 if not both else min(1.0, max(0.0, 2 * sum(v * w for v, w in zip(x, y)) / both))


ROWS = [(5, "a\nb\nc\nd"), (4, "b\n\na\nd\nc"), (4, "b\n\na\nd\nc"), (4, "b\n\na\nd\nc"), (4, "other"), (3, None), (2, ""), (None, "x\ny"), (None, "y\nx"), (9, "ñandú\n日本\U0001f600é\nend"), (7, "no line break at all")]


@pytest.mark.parametrize("rows", [ROWS, [(1, "alone\nof all")], [(1, "ab"), (1, "ab")]])
def test_edits_equal_plain_ones(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in P.edited_documents(docs).select("doc_id", "n_chars", "text", "edited", "mark", "edited_mark", "near_edited", "near_next").collect()]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter(plain_edits(rows))
    for _, n, text, edited, mark, edited_mark, near, _ in got:
        assert n == len(text) and mark == plain_mark(lines(text)) and edited_mark == plain_mark(lines(edited))
        assert near == pytest.approx(likeness(mark, edited_mark), abs=1e-12)


def test_order_does_not_count_and_parts_add_up(spark):
    text = spark.createDataFrame([("a\nb\nc", "c\na\nb", "b", "a\nc")], "one string, other string, part string, rest string")
    mark = lambda c: P.fingerprint(P.paragraphs(F.col(c)))
    r = text.select(mark("one").alias("one"), mark("other").alias("other"), P.deleted(mark("one"), mark("part")).alias("less"), mark("rest").alias("rest"),
                    P.inserted(P.deleted(P.fingerprint(P.paragraphs(F.lit(""))), mark("part")), mark("one")).alias("early")).first()
    assert r["one"] == r["other"] and r["less"] == r["rest"] == r["early"]


def test_likeness_follows_the_common_share(spark):
    share = lambda n: "\n".join([f"same {i}" for i in range(n)] + [f"own {n} {i}" for i in range(200 - n)])
    rows = [(share(200), share(n), n / 200) for n in (0, 50, 100, 150, 200)]
    m = [P.fingerprint(P.paragraphs(F.col(c))) for c in ("a", "b")]
    got = spark.createDataFrame(rows, "a string, b string, share double").select("share", P.likeness(P.product(*m), P.product(m[0], m[0]), P.product(m[1], m[1])).alias("near")).collect()
    assert all(abs(r["near"] - r["share"]) < 0.15 for r in got) and [r["near"] for r in got if r["share"] == 1] == [1.0]


def test_odd_and_no_rows(odd_docs, no_docs):
    got = P.edited_documents(odd_docs)
    assert got.count() == odd_docs.count()
    by_text = {(r["text"], tuple(r["mark"])) for r in got.select("text", "mark").collect()}
    assert len(by_text) == len({t for t, _ in by_text})
    assert P.edited_documents(no_docs).count() == 0
