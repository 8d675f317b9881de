"""Token ids of a corpus in shard files, each a wavelet matrix, in ascending order of documents."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewscope.llm.tokens import END_ID, documents, encoder
from renewscope.llm.wavelet import WaveletMatrix, build
from renewscope.session import through_table

#: Ids of a shard file, about: it closes with the document that reaches them.
SHARD_IDS = 1 << 21
#: Different parts of texts whose ids a worker keeps, at about 120 bytes each: here a worker does nothing else that needs memory.
CACHE = 1_000_000
#: Documents that one range of the order holds, about.
RANGE_DOCS = 8192


def _tokenized(docs: DataFrame, tokenizer: str, text: str, key: str, end_id: int) -> DataFrame:
    """doc_id, tie, ids (binary) of every document; tie is the md5 of its text."""

    def run(batches):
        encode = encoder(tokenizer, True, CACHE)
        for batch in batches:
            rows, blobs, size = [], [], 0
            for row, ids in documents(batch.column(2), tokenizer, end_id, True, encode):
                rows.append(row), blobs.append(ids.tobytes())
                size += len(blobs[-1])
                if size > 1 << 23 or row == batch.num_rows - 1:
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(blobs, pa.binary())], ["doc_id", "tie", "ids"])
                    rows, blobs, size = [], [], 0

    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.md5(body).alias("tie"), body.alias("text"))
    return named.mapInArrow(run, "doc_id long, tie string, ids binary")


def _cuts(docs: DataFrame, key: str, per: int) -> list[int]:
    """Ids that cut the order into ranges of about `per` documents; one number each comes to the driver."""
    count = max(1, -(-docs.count() // per))
    if count == 1:
        return []
    found = docs.select(F.percentile_approx(key, [i / count for i in range(1, count)], 10 * count)).first()[0]
    return sorted(set(found or []))


def _range_of(cuts: list[int], key: Column) -> Column:
    """Number of cuts below an id, found by halving; null ids are in the first range."""
    bounds, steps = F.array(*[F.lit(c) for c in cuts]), F.sequence(F.lit(1), F.lit(max(1, len(cuts)).bit_length()))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        below = F.struct(s["low"].alias("low"), middle.alias("high"))
        return F.when(s["low"] >= s["high"], s).otherwise(F.when(F.get(bounds, middle) < key, above).otherwise(below))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.coalesce(F.when(key.isNotNull(), F.aggregate(steps, start, halve)["low"]), F.lit(0)) if cuts else F.lit(0)


def _written(name: str, data: bytes, folder: str) -> None:
    """Written aside, then renamed: a task that runs twice leaves the same file."""
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    aside = f"{root}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(data)
    system.move(aside, f"{root}/{name}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", key: str = "doc_id",
                 end_id: int = END_ID, shard_ids: int = SHARD_IDS, range_docs: int = RANGE_DOCS) -> DataFrame:
    """Writes the ids of all documents to files `<range>-<number>.wm` in a folder (a URI or path that
    all machines share); returns their list: file, range, number, ids.

    Order: integer ids ascending, nulls first, equal ids by the md5 of the text; repeated rows are
    documents of their own. A null or empty text is the end id alone; an empty table gives no
    file. Ids, not texts, are put in order: each range of documents is one task, which sorts its
    rows and writes its files, so memory holds one shard and its longest document.
    """
    cuts = _cuts(docs, key, range_docs)
    numbered = _tokenized(docs, tokenizer, text, key, end_id).withColumn("range", _range_of(cuts, F.col("doc_id")).cast("int"))
    ordered = numbered.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def write(batches):
        dtype = encoder(tokenizer, True, CACHE).dtype
        listed, held, docs_in, size, place = [], [], [], 0, None

        def close():
            name = f"{place:08d}-{len(listed):08d}.wm"
            ids = np.concatenate(held)
            _written(name, build(ids, 8 * dtype.itemsize, {"docs": docs_in}), folder)
            listed.append((name, place, len(listed), len(ids)))

        for batch in batches:
            for row in range(batch.num_rows):
                place = batch.column(3)[row].as_py()
                ids = np.frombuffer(batch.column(2)[row].as_py(), dtype)
                held.append(ids), docs_in.append([batch.column(0)[row].as_py(), len(ids)])
                size += len(ids)
                if size >= shard_ids:
                    close()
                    held, docs_in, size = [], [], 0
        if held:
            close()
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in listed], t) for i, t in enumerate(kinds)], ["file", "range", "number", "ids"])

    return through_table(ordered.mapInArrow(write, "file string, range int, number int, ids long"), "shard-list")


def read_shards(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file of every document, from the files and their list.

    Spark reads the files; only one row a file is put in order in one place. A list without files, as
    an empty table gives, has no rows."""
    if not listed.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    order = Window.orderBy("range", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = listed.select("file", F.coalesce(F.sum("ids").over(order), F.lit(0)).cast("long").alias("before"))

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix = WaveletMatrix(batch.column(1)[row].as_py())
                ids = matrix.decode().astype("<u4")
                sizes = np.array([n for _, n in matrix.meta["docs"]], np.int64)
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[row].as_py()] * len(sizes)), pa.array([d for d, _ in matrix.meta["docs"]], pa.int64()),
                    pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], ["file", "doc_id", "offset", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    found = files.mapInArrow(read, "file string, doc_id long, offset long, n_tokens long, ids_crc32 long")
    found = found.join(starts, "file")
    return found.select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "file")
