"""A wavelet matrix of a sequence of ids, as one compressed file.

Bit-planes run from the highest bit of an id to the lowest. At each plane the ids whose bit is 0
go before those whose bit is 1, in order; the number of zeros is kept. Each plane is cut into
blocks of bits, each compressed on its own where that is smaller, with the number of ones before
the block, so access, counting and lookup of occurrences read single blocks.

File: magic, header length, header (JSON), then the blocks one after the other.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

MAGIC = b"WMX1"
#: Bits of a block.
BLOCK = 1 << 16


def build(ids: np.ndarray, bits: int, meta: dict | None = None) -> bytes:
    """The file of ids below 2 ** bits; `meta` goes into its header."""
    planes, parts, at = [], [], 0
    left = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
    for bit in range(bits - 1, -1, -1):
        ones = (left & left.dtype.type(1 << bit)) != 0
        blocks, before = [], 0
        for k in range(0, len(ones), BLOCK):
            part = ones[k : k + BLOCK]
            raw = np.packbits(part, bitorder="little").tobytes()
            small = zlib.compress(raw, 1)
            packed = len(small) < len(raw)
            parts.append(small if packed else raw)
            blocks.append((at, len(parts[-1]), int(packed), before))
            at += len(parts[-1])
            before += int(np.count_nonzero(part))
        planes.append({"zeros": int(len(ones) - before), "blocks": blocks})
        left = np.concatenate((left[~ones], left[ones]))
    header = json.dumps({"n": len(ids), "bits": bits, "block": BLOCK, "planes": planes, "meta": meta or {}}, separators=(",", ":")).encode()
    header = zlib.compress(header, 6)
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *parts])


class WaveletMatrix:
    """Reads a file; a few decompressed blocks are kept."""

    KEPT = 256

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        (length,) = struct.unpack("<I", data[4:8])
        header = json.loads(zlib.decompress(data[8 : 8 + length]))
        self.body = memoryview(data)[8 + length :]
        self.n, self.bits, self.block, self.meta = header["n"], header["bits"], header["block"], header["meta"]
        self.planes = header["planes"]
        self._open: dict[tuple[int, int], np.ndarray] = {}

    def _ones(self, plane: int, block: int) -> np.ndarray:
        """Ones up to each place of a block, itself not included; one more place at the end."""
        key = (plane, block)
        if key not in self._open:
            if len(self._open) >= self.KEPT:
                self._open.clear()
            bits = self._bits(plane, block)
            self._open[key] = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
        return self._open[key]

    def _bits(self, plane: int, block: int) -> np.ndarray:
        at, size, packed, _ = self.planes[plane]["blocks"][block]
        raw = bytes(self.body[at : at + size])
        raw = zlib.decompress(raw) if packed else raw
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=min(self.block, self.n - block * self.block))

    def rank1(self, plane: int, at: int) -> int:
        """Ones of a plane before place `at`."""
        if at <= 0:
            return 0
        block, inside = divmod(at, self.block)
        if block * self.block >= self.n or block >= len(self.planes[plane]["blocks"]):
            return self.n - self.planes[plane]["zeros"]
        return self.planes[plane]["blocks"][block][3] + int(self._ones(plane, block)[inside])

    def select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) `bit` of a plane, by the blocks' counts, then inside one block."""
        blocks = self.planes[plane]["blocks"]
        low, high = 0, len(blocks) - 1
        before = lambda b: blocks[b][3] if bit else b * self.block - blocks[b][3]
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if before(middle) <= k else (low, middle - 1)
        ones = self._ones(plane, low)
        counts = ones if bit else np.arange(len(ones)) - ones
        return low * self.block + int(np.searchsorted(counts, k - before(low), side="right")) - 1

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.bits):
            ones = self.rank1(plane, at)
            bit = self.rank1(plane, at + 1) - ones
            value = value << 1 | bit
            at = self.planes[plane]["zeros"] + ones if bit else at - ones
        return value

    def rank(self, value: int, upto: int) -> int:
        """How often an id occurs before place `upto`."""
        start, end = self._range(value, upto)
        return end - start

    def _range(self, value: int, upto: int) -> tuple[int, int]:
        start, end = 0, min(upto, self.n)
        for plane in range(self.bits):
            a, b = self.rank1(plane, start), self.rank1(plane, end)
            zeros = self.planes[plane]["zeros"]
            start, end = (zeros + a, zeros + b) if value >> (self.bits - 1 - plane) & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def occurrence(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        start, end = self._range(value, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for plane in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - plane) & 1
            at = self.select(plane, bit, at - self.planes[plane]["zeros"] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids: planes are undone from the lowest bit to the highest."""
        bits = [np.concatenate([self._bits(p, b) for b in range(len(self.planes[p]["blocks"]))]) if self.n else np.zeros(0, np.uint8) for p in range(self.bits)]
        ids = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            ones = bits[plane].view(bool)
            back = np.empty_like(ids)
            zeros = self.planes[plane]["zeros"]
            back[~ones], back[ones] = ids[:zeros], ids[zeros:] | ids.dtype.type(1 << self.bits - 1 - plane)
            ids = back
        return ids
