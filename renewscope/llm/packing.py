"""Hierarchical packing of documents into windows of several lengths.

Documents are cut into full windows of the longest length; what is left is routed to the
smallest tier (power of two) that holds it. Tiers are packed from the longest down: a window
begins with its tier's longest piece, its gap is filled with the longest pieces of shorter tiers
that fit, and the last of the gap with the beginning of one that doesn't. So every window is
exactly as long as its tier. Windows go to step groups of equal numbers of tokens.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewscope.llm.tokens import END_ID, documents, encoder

WINDOW = 1024
#: Shortest tier of pieces; below it, only the last ids of a partition come in shorter windows.
SHORTEST = 64
#: Ids of one step group, and of the pieces that wait before they are packed.
STEP_TOKENS, WAITING = 1 << 16, 1 << 20


@dataclass(order=True)
class Piece:
    """A stretch of a document; ordered by length, then by the order of arrival."""

    length: int
    number: int
    doc: object = field(compare=False)
    start: int = field(compare=False)
    ids: np.ndarray = field(compare=False)
    doc_tokens: int = field(compare=False)

    def head(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids, and the rest."""
        a = Piece(n, self.number, self.doc, self.start, self.ids[:n], self.doc_tokens)
        return a, Piece(self.length - n, self.number, self.doc, self.start + n, self.ids[n:], self.doc_tokens)


class Packer:
    """Packs the documents of one partition; memory holds at most WAITING ids and what was packed of them.

    Pieces below half of the shortest tier fill gaps; where so many wait that they alone reach half
    of the limit, the shortest tier is packed from them."""

    def __init__(self, window: int = WINDOW, shortest: int = SHORTEST, waiting: int = WAITING):
        self.tiers = [window >> k for k in range(window.bit_length()) if window >> k >= min(shortest, window)]
        self.window, self.waiting = window, waiting
        self.pool: list[Piece] = []
        self.held, self.number = 0, 0
        self.done: list[list[Piece]] = []

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self._close([Piece(self.window, 0, doc, at, ids[at : at + self.window], len(ids))])
        if whole < len(ids):
            self._keep(Piece(len(ids) - whole, self.number, doc, whole, ids[whole:].copy(), len(ids)))
            self.number += 1

    def ready(self) -> bool:
        return self.held > self.waiting

    def _keep(self, piece: Piece) -> None:
        insort(self.pool, piece)
        self.held += piece.length

    def _take(self, index: int) -> Piece:
        piece = self.pool.pop(index)
        self.held -= piece.length
        return piece

    def _close(self, pieces: list[Piece]) -> None:
        self.done.append(pieces)

    def pack(self, last: bool = False) -> list[list[Piece]]:
        """All windows that are full by now; with `last`, windows of all ids."""
        for tier in self.tiers:
            while self.pool and self.pool[-1].length > tier // 2 and self.held >= tier:
                self._fill(tier)
        if self.held > self.waiting // 2:
            while self.held >= self.tiers[-1]:
                self._fill(self.tiers[-1])
        if last:
            tier = self.window
            while self.held:  # less than the shortest tier, or than the longest piece's: powers of two
                while tier > self.held:
                    tier //= 2
                self._fill(tier)
        done, self.done = self.done, []
        return done

    def _fill(self, tier: int) -> None:
        """One window of a tier: its longest piece, the longest shorter ones that fit, the head of one more."""
        window, gap = [], tier
        while gap:
            fits = bisect_right(self.pool, gap, key=lambda p: p.length)
            if fits:
                piece = self._take(fits - 1)
            else:  # the shortest of all is longer than the gap
                piece, rest = self._take(0).head(gap)
                self._keep(rest)
            window.append(piece)
            gap -= piece.length
        self._close(window)


def step_groups(windows: list[list[Piece]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window: longest windows first, each to the group with fewest ids so far."""
    sizes = [sum(p.length for p in w) for w in windows]
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (load + sizes[i], g))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID,
                   window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group and, if asked
    for, ids (binary, little-endian, two bytes an id where the vocabulary allows it).

    Every id of every document lies in exactly one piece; a null or empty text is the end id
    alone; repeated rows, also those with equal ids, are packed one by one; an empty table gives no
    piece. Each partition is packed on its own, and its last ids go to shorter and shorter powers of
    two, so nothing is padded; a sequence's number is its partition's and its place in it.
    """
    kind = docs.schema[key].dataType.simpleString()
    columns = [("doc_id", None), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
               ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    if with_ids:
        columns.append(("ids", pa.binary()))
        schema += ", ids binary"

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        sequence, group, dtype = base, base, encoder(tokenizer, True).dtype
        packer, id_type = Packer(window), None

        def rows(windows):
            nonlocal sequence, group
            out = {name: [] for name, _ in columns}
            groups = step_groups(windows)
            for pieces, g in zip(windows, groups):
                offset = 0
                for p in pieces:
                    values = (p.doc, p.start, p.length, zlib.crc32(p.ids.astype("<u4")), p.doc_tokens, sequence, offset, 0, group + g)
                    for (name, _), v in zip(columns, values):
                        out[name].append(v)
                    if with_ids:
                        out["ids"].append(p.ids.astype(dtype).tobytes())
                    offset += p.length
                out["tier"][-len(pieces):] = [offset] * len(pieces)
                sequence += 1
            group += max(groups, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(out[name], id_type if t is None else t) for name, t in columns], [name for name, _ in columns])

        for batch in batches:
            id_type = batch.schema.field(0).type
            keys = batch.column(0)
            for row, ids in documents(batch.column(1), tokenizer, end_id, True):
                packer.add(keys[row].as_py(), ids)
                if packer.ready() or len(packer.done) > 1024:
                    windows = packer.pack() if packer.ready() else packer.done
                    packer.done = []
                    yield rows(windows)
        if id_type is not None:
            yield rows(packer.pack(last=True))

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)
