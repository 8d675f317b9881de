import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from renewscope.llm import packing, token_files, tokens, wavelet
from renewscope.llm.packing_query import op8_packing
from renewscope.llm.token_files_query import op7_token_files
from renewscope.session import shared_dir

PATH = tokens.default_tokenizer()


@pytest.fixture(scope="module")
def encode():
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 0]


def encoded(texts):
    return [ids.tolist() for _, ids in tokens.documents(pa.array(texts, pa.string()), PATH)]


HARD = ["", None, " ", "  ", " a", "a ", "a  b", "\n", " \n x", "don't we'll 's", "it 's", " it's x'", "foo bar   z", "a\x1c b \x1cc", " \x85q", "a\n\nB\nC.\nD \nE",
        "<|endoftext|> x", "x <|endoftext|>", "日本 語 テ", "a1b2 3c, d!!", "ſt ǅ ª º", "word'  'll", "é cafés", "x　 y  z"]


def test_ids_equal_the_library_s(documents, encode):
    texts = HARD + [r["text"] for r in documents.limit(60).collect()]
    assert encoded(texts) == [encode(t) for t in texts]


@pytest.mark.parametrize("alphabet", [" \n\t\x0b\x1c\x85 　abcDE'sltrev.,!0129éßñ日-|*%", " \n\n abc.A"])
def test_ids_of_random_texts(encode, alphabet):
    rng = random.Random(4)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(4000)]
    assert encoded(texts) == [encode(t) for t in texts]


def test_long_texts_and_a_full_cache(documents, encode, monkeypatch):
    monkeypatch.setattr(tokens, "_BLOCK", 500)
    small = tokens.Encoder(PATH, cache=300)
    monkeypatch.setattr(tokens, "encoder", lambda path: small)
    texts = [r["text"] for r in documents.limit(40).collect()] + ["x" * 3000 + " y", "é" * 2000]
    assert encoded(texts) == [encode(t) for t in texts]


@pytest.mark.parametrize("size", [0, 1, 63, 5000])
def test_wavelet_matrix(size, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 1 << 8)
    ids = np.random.default_rng(size).zipf(1.3, size) % 60_000
    matrix = wavelet.WaveletMatrix(wavelet.build(ids, 16, {"a": 1}))
    assert matrix.n == size and matrix.meta == {"a": 1} and (matrix.decode() == ids).all()
    for at in range(0, size, max(1, size // 50)):
        value = int(ids[at])
        assert matrix.access(at) == value
        assert matrix.rank(value, at) == int((ids[:at] == value).sum()) and matrix.count(value) == int((ids == value).sum())
        assert matrix.occurrence(value, matrix.rank(value, at)) == at
    assert matrix.count(61_000) == 0
    with pytest.raises(IndexError):
        matrix.occurrence(61_000, 0)
    with pytest.raises(IndexError):
        matrix.access(size)


def check_files(rows, ordered, encode):
    at = 0
    assert len(rows) == len(ordered)
    for row, (doc, text) in zip(sorted(rows, key=lambda r: r["start"]), ordered):
        ids = encode(text)
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, at, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_files_of_documents(spark, sf_dir, documents, encode):
    rows = op7_token_files(spark, sf_dir).collect()
    check_files(rows, sorted((r["doc_id"], r["text"]) for r in documents.collect()), encode)


def test_files_of_several_ranges(spark, documents, encode):
    folder = shared_dir(spark, "files")
    listed = token_files.write_shards(documents, folder, PATH, shard_ids=5000, range_docs=30)
    assert listed.select("range").distinct().count() > 3 and listed.count() > 10
    rows = token_files.read_shards(spark, folder, listed).collect()
    check_files(rows, sorted((r["doc_id"], r["text"]) for r in documents.collect()), encode)


def test_files_of_odd_rows(spark, odd_docs, no_docs, encode):
    folder = shared_dir(spark, "files")
    rows = token_files.read_shards(spark, folder, token_files.write_shards(odd_docs, folder, PATH, range_docs=4)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.collect())
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    in_order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert in_order == sorted(in_order, key=lambda d: -1 if d is None else d)
    want = Counter(zlib.crc32(np.array(encode(r["text"]), "<u4").tobytes()) for r in odd_docs.collect())
    assert Counter(r["ids_crc32"] for r in rows) == want
    nothing = token_files.write_shards(no_docs, shared_dir(spark, "files"), PATH)
    assert nothing.count() == 0 and token_files.read_shards(spark, shared_dir(spark, "files"), nothing).count() == 0


def check_pieces(rows, window=1024):
    """Gapless sequences, no padding; returns the ids of each sequence's documents in pieces."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end and r["length"] > 0
            end += r["length"]
        assert end <= window and end & (end - 1) == 0 and {r["tier"] for r in pieces} == {end}
    return sequences


def test_packing_of_documents(spark, sf_dir, documents, encode):
    rows = op8_packing(spark, sf_dir).collect()
    check_pieces(rows)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for doc in documents.collect():
        ids, at = np.array(encode(doc["text"]), "<u4"), 0
        for r in sorted(by.pop(doc["doc_id"]), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by


def test_packing_of_odd_rows(odd_docs, no_docs, encode):
    rows = packing.pack_documents(odd_docs, PATH).collect()
    check_pieces(rows)
    assert all(len(r["ids"]) == 2 * r["length"] for r in rows)
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    want = Counter()
    for d in odd_docs.collect():
        want[d["doc_id"]] += len(encode(d["text"]))
    assert total == want
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_packer_holds_little_and_steps_are_balanced():
    rng = random.Random(8)
    packer = packing.Packer(window=256, shortest=16, waiting=4000)
    windows, given = [], 0
    for doc in range(3000):
        n = rng.choice([1, 5, 40, 130, 200, 255, 256, 300, 2000])
        given += n
        packer.add(doc, np.arange(n))
        if packer.ready():
            windows += packer.pack()
            assert packer.held < 256
    windows += packer.pack(last=True)
    assert packer.held == 0 and sum(p.length for w in windows for p in w) == given
    assert sum(len(w) for w in windows) < 3000 + 2 * len(windows)
    groups = packing.step_groups(windows, 1 << 13)
    loads = Counter()
    for w, g in zip(windows, groups):
        loads[g] += sum(p.length for p in w)
    assert max(loads.values()) - min(loads.values()) <= 256


@pytest.fixture(scope="module")
def untouched():
    library = Tokenizer.from_file(PATH)
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 0]


MARK = "<|endoftext|>"
MARKED = ["end of one.<|endoftext|>Next begins", MARK, MARK * 3, f"a  {MARK} b \n{MARK}\nC", f" {MARK} {MARK}", "<|endoftext|", "|>x", f"<|endof{MARK}", f"it{MARK}'s"]


def test_added_tokens_as_in_an_untouched_library(untouched):
    rng = random.Random(5)
    pieces = [MARK, "<|endof", "text|>", "<", "|", ">", " ", "  ", "\n", "Ab", ".", "'s", "é", "12"]
    texts = MARKED + ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(4000)]
    got = [ids.tolist() for _, ids in tokens.documents(pa.array(texts, pa.string()), PATH, added=True)]
    assert got == [untouched(t) for t in texts] and got[0] == [437, 286, 530, 13, 50256, 10019, 6140, 0]


@pytest.mark.parametrize("block", [1, 7, 20, 64])
def test_added_tokens_of_long_texts(untouched, monkeypatch, block):
    monkeypatch.setattr(tokens, "_BLOCK", block)
    rng = random.Random(block)
    texts = ["".join(rng.choices([MARK, " ", "word", ".", "\n", "<|", "x "], k=60)) for _ in range(60)]
    got = [ids.tolist() for _, ids in tokens.documents(pa.array(texts, pa.string()), PATH, added=True)]
    assert got == [untouched(t) for t in texts]


def test_files_and_packing_of_added_tokens(spark, untouched):
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    folder = shared_dir(spark, "files")
    rows = token_files.read_shards(spark, folder, token_files.write_shards(docs, folder, PATH)).collect()
    check_files(rows, list(enumerate(MARKED)), untouched)
    ids = defaultdict(list)
    for r in sorted(packing.pack_documents(docs, PATH).collect(), key=lambda r: r["start"]):
        ids[r["doc_id"]] += np.frombuffer(r["ids"], "<u2").tolist()
    assert ids == {i: untouched(t) for i, t in enumerate(MARKED)}


def test_packer_does_not_keep_short_pieces():
    packer = packing.Packer(window=256, shortest=64, waiting=1000)
    windows, given, packed = [], 0, 0
    for doc in range(5000):
        n = doc % 4 + 1 if doc % 100 else 300
        given += n
        packer.add(doc, np.arange(n))
        if packer.ready():
            packed += 1
            windows += packer.pack()
            assert packer.held <= 500
    windows += packer.pack(last=True)
    assert packed < 55 and packer.held == 0 and sum(p.length for w in windows for p in w) == given
    assert all(sum(p.length for p in w) in (256, 128, 64) for w in windows[:-7])
