"""SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewscope.llm.common import fresh, utf8
from renewscope.llm.covering import home_anchor, visited_anchors
from renewscope.llm.graph import components
from renewscope.operators.skew import join_unique
from renewscope.session import through_table

SEED = 42
#: Bytes of one text and shingles that are looked at in one go.
_BYTES, _SHINGLES = 1 << 22, 1 << 14
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _parts(data: np.ndarray, start: int, end: int):
    """Words of a text in parts of bounded size, cut at white space."""
    while start < end:
        stop = min(end, start + _BYTES)
        if stop < end:
            found = np.flatnonzero(_SPACE[data[start:stop]])
            while not len(found) and stop < end:  # a word longer than a part
                stop = min(end, stop + _BYTES)
                found = np.flatnonzero(_SPACE[data[start:stop]])
            stop = start + int(found[-1]) + 1 if len(found) and stop < end else stop
        # lower() changes A-Z only and split() cuts at the six white-space bytes only.
        yield data[start:stop].tobytes().lower().split()
        start = stop


def fingerprint(data: np.ndarray, start: int, end: int, shingle: int) -> int:
    """Bit i is 1 if it is set in over half the hashes of the text's shingles."""
    digest, ones, total, carry, words = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, [], []
    for words in _parts(data, start, end):
        words = carry + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            begin, finish = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
            for k in range(0, len(begin), _SHINGLES):
                hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[k : k + _SHINGLES], finish[k : k + _SHINGLES])], "<u8")
                ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                total += len(hashes)
        carry = words[len(words) - shingle + 1 :] if shingle > 1 else []
        if len(words) < shingle:
            carry = words
    if not total:
        return digest(b" ".join(carry), SEED) if carry else 0
    bits = np.packbits(ones * 2 > total, bitorder="little").view("<u8")
    return int(bits[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a (signed) long; a null text has none of its words, so 0."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        data, ends = utf8(texts)
        values = [fingerprint(data, int(ends[i]), int(ends[i + 1]), shingle) for i in range(len(texts))]
        return pa.array(np.array(values, np.uint64).astype(np.int64), pa.int64())

    return of(F.coalesce(text, F.lit("")))


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of different fingerprints of a table `fp` that differ in at most `distance` bits.

    Each fingerprint goes home to one anchor and visits all anchors within covering radius plus
    distance; only homes and visitors of one anchor are compared, so each pair is met once, at the
    home of its smaller member. An anchor that holds very many is a skewed join, which Spark splits.
    """

    def home(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(home_anchor(fp)), batch.column(0)], ["anchor", "a"])

    def visits(batches):
        for batch in batches:
            every = batch.column(0).to_numpy()
            for k in range(0, len(every), 4096):
                fp = every[k : k + 4096]
                row, anchor = visited_anchors(fp.view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row])], ["at", "b"])

    homes = prints.select("fp").mapInArrow(home, "anchor long, a long")
    visitors = prints.select("fp").mapInArrow(visits, "at long, b long")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # Spark takes a fingerprint's some 60 visits for one row and would broadcast them all.
    return homes.join(visitors.hint("merge"), (F.col("anchor") == F.col("at")) & (F.col("a") < F.col("b")) & close).select("a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, row_hash, fp, component_id, kept of every document.

    Fingerprints over word shingles link at `distance` or fewer differing bits; a component's id
    is its smallest doc_id (null only if all its ids are null). `kept` marks the representative:
    smallest id, then smallest hash of id and text, so that equal rows are marked alike.

    Null and empty texts have fingerprint 0 and link like any other; texts with fewer words than
    a shingle are one shingle; copies share a fingerprint, so links are searched between distinct
    fingerprints only. An empty table gives none. Other columns are not looked at.
    """
    text_, id_ = F.col(text), F.col(key)
    row_hash = F.md5(F.concat_ws("|", F.coalesce(id_.cast("string"), F.lit("-")), F.coalesce(text_, F.lit(""))))
    rows = through_table(docs.select(id_.alias("doc_id"), row_hash.alias("row_hash"), fingerprint_column(text_, shingle).alias("fp")), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("first")
    prints = through_table(rows.groupBy("fp").agg(first, F.count("*").alias("n")), "simhash-prints")
    roots = components(links(prints, distance))
    # Written tables are several times as large in memory as stored, so that their joins by fingerprint are merged too.
    rooted = prints.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = through_table(rooted, "simhash-roots")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("one"))
    of_print = through_table(rooted.join(firsts.hint("merge"), "root").select("fp", "one", "n"), "simhash-groups")
    return join_unique(rows, of_print, ["fp"], "n").select(
        "doc_id", "row_hash", "fp", F.col("one.doc_id").alias("component_id"),
        (F.col("row_hash") == F.col("one.row_hash")).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One document of each group, with all its columns; equal rows are one document."""
    mark = fresh(docs, "row_hash")
    kept = near_duplicates(docs, shingle=shingle, distance=distance).where("kept").select(F.col("row_hash").alias("kept_hash")).distinct()
    row_hash = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("text"), F.lit(""))))
    stays = docs.withColumn(mark, row_hash).join(kept.hint("merge"), F.col(mark) == F.col("kept_hash"), "left_semi")
    return stays.dropDuplicates([mark]).drop(mark)
