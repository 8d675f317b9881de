"""Token ids of whole texts by a public byte-level BPE tokenizer, with a bounded cache of parts.

The tokenizer splits a text by a pattern and encodes the pieces one by one. At some places a
piece ends whatever stands around it: before a space that something other than white space
follows; between an ASCII letter and a sign; between a single line feed and an ASCII letter.
Texts are cut there, for whole batches at once, and each different part is encoded by the
library once while it stays in the cache. Tests hold the ids against those of whole texts.

With `added`, the tokenizer's added tokens are found in texts, as the library does by itself:
each literal is a part of its own and ends what stands before it. Without, they are plain text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from renewscope.llm.common import powers, spans_of, utf8

#: Parts that one worker keeps; beyond that it begins anew.
CACHE = 400_000
END_ID = 0
_BLOCK = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0x100000001B3, 0x9E3779B97F4A7C55)

_LETTER, _SIGN, _SOLID, _FOLLOWS = (np.zeros(256, bool) for _ in range(4))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[list(b".,;:!?%$&#*|()[]{}\"-")] = True
_SOLID[33:127] = True
# What may follow a space for a piece to begin: no white space, and no byte that begins some.
_FOLLOWS[:] = True
_FOLLOWS[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Letters of Latin scripts: one piece, whatever version of Unicode splits it.
_WORD = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the others by 256 and up, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(printable))
    return {chr(b): chr(b) for b in printable} | {chr(b): chr(256 + k) for k, b in enumerate(others)}


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span."""
    out, values = [], data.astype(np.uint64) + np.uint64(1)
    size = max(_BLOCK * 2, 1 << len(data).bit_length())
    with np.errstate(over="ignore"):
        for base in _BASES:
            up, down = powers(base, size)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values * up[: len(data)], out=sums[1:])
            h = ((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)) * _MIX
            out.append(h ^ (h >> np.uint64(31)))
    return out[0], out[1]


class Encoder:
    """Ids of texts, by the tokenizer of a file."""

    def __init__(self, path: str, cache: int = CACHE, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder().values() if added else []
        # Tokens that take white space in or look at what stands around them leave no safe place to cut.
        self.cuts = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens)
        literals = sorted((t.content.encode() for t in tokens), key=len, reverse=True)
        self.literals = re.compile(b"|".join(map(re.escape, literals))) if literals else None
        self.longest = max(map(len, literals), default=0)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.letters = str.maketrans(_byte_letters())
        self.cache = cache
        self._clear()

    def _clear(self) -> None:
        self.known, self.used = 0, 0
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, self.dtype)
        self._slots(14)

    def _slots(self, bits: int) -> None:
        self.bits = bits
        self.first, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.at = np.full(1 << bits, -1, np.int32)

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        slot = (first >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.at[slot]
        other = np.flatnonzero(((self.first[slot] != first) | (self.second[slot] != second)) & (found >= 0))
        slot = slot[other]
        while len(other):
            slot = (slot + 1) & mask
            row = self.at[slot]
            done = (row < 0) | ((self.first[slot] == first[other]) & (self.second[slot] == second[other]))
            found[other[done]] = row[done]
            other, slot = other[~done], slot[~done]
        return found

    def _put(self, first: np.ndarray, second: np.ndarray, number: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (first >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(number):
            free = self.at[slot] < 0
            self.at[slot[free]] = number[free]
            placed = self.at[slot] == number
            self.first[slot[placed]], self.second[slot[placed]] = first[placed], second[placed]
            first, second, number, slot = first[~placed], second[~placed], number[~placed], (slot[~placed] + 1) & mask

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Encode parts that are new and keep them."""
        texts = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())]
        plain = [bool(_WORD.fullmatch(t)) and not (self.literals and self.literals.search(t.encode())) for t in texts]
        rest = iter(self.tokenizer.encode_batch([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        tokenize, letters = self.model.tokenize, self.letters
        # A word is one piece, so the library's splitting has nothing to do there.
        lists = [[x.id for x in tokenize(t.encode().decode("latin-1").translate(letters))] if p else next(rest).ids for t, p in zip(texts, plain)]
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        flat = np.fromiter((i for x in lists for i in x), self.dtype, int(sizes.sum()))
        old, new = self.known, self.known + len(lists)
        if new > len(self.begin):
            self.begin, self.size = (np.concatenate([x[:old], np.zeros(2 * new - old, x.dtype)]) for x in (self.begin, self.size))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(flat), self.dtype)])
        self.begin[old:new] = self.used + np.cumsum(sizes) - sizes
        self.size[old:new] = sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.known, self.used = new, self.used + len(flat)
        if 2 * new > 1 << self.bits:
            kept = self.at >= 0
            f, s, n = self.first[kept], self.second[kept], self.at[kept]
            self._slots(int(4 * new).bit_length())
            self._put(f, s, n)
        self._put(first, second, np.arange(old, new, dtype=np.int32))

    def _parts(self, data: np.ndarray, begins: np.ndarray, stops: np.ndarray, whole: bool) -> np.ndarray:
        """Where parts begin in a stretch of texts that lie one behind the other."""
        if not self.cuts:
            return begins
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 0x20) & _FOLLOWS[data[1:]]
        cut[stops - 1] = False  # what follows is another text
        cut[1:] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
        cut[2:] |= (data[1:-1] == 0x0A) & _SOLID[data[:-2]] & _LETTER[data[2:]]
        raw = data.tobytes() if self.literals else b""
        if self.literals and self.literals.search(raw):
            found = [m.span() for a, b in zip(begins.tolist(), stops.tolist()) for m in self.literals.finditer(raw, a, b)]
            for a, b in found:
                cut[max(a - 1, 0) : b] = False  # a space before a literal ends its text
            edges = np.array(found, np.int64).reshape(-1)
            cut[edges[edges < len(data)]] = True
        if not whole and self.longest:
            cut[max(len(data) - self.longest, 0) :] = False  # a literal may begin here and end behind
        cut[begins] = True
        return np.flatnonzero(cut)

    def _stretch(self, data: np.ndarray, begins: np.ndarray, stops: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids, their number for each text, and how far the stretch was read (to the end if `whole`)."""
        starts = self._parts(data, begins, stops, whole)
        read = len(data)
        if not whole and len(starts) > 1:
            read, starts = int(starts[-1]), starts[:-1]
        ends = np.append(starts[1:], read)
        first, second = _hashes(data, starts, ends)
        row = self._find(first, second)
        new = np.flatnonzero(row < 0)
        if len(new):
            if self.known + len(new) > self.cache:
                self._clear()
                new = np.arange(len(row))
            new = new[np.unique(first[new], return_index=True)[1]]
            self._learn(data, starts[new], ends[new], first[new], second[new])
            row = self._find(first, second)
            if (row < 0).any():  # two new parts with one first hash
                left = np.flatnonzero(row < 0)
                self._learn(data, starts[left], ends[left], first[left], second[left])
                row = self._find(first, second)
        sizes = self.size[row].astype(np.int64)
        ids = self.ids[spans_of(self.begin[row], sizes)]
        counted = np.concatenate(([0], np.cumsum(sizes)))
        edges = np.append(np.searchsorted(starts, begins), len(starts))
        return ids, np.diff(counted[edges]), read

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(first row, ids, number of ids for each row, last part) of stretches of rows, in order.

        A long text comes in several stretches of its own, and all but its last say so."""
        data, ends = utf8(texts)
        row = 0
        while row < len(ends) - 1:
            upto = max(row + 1, int(np.searchsorted(ends, ends[row] + _BLOCK, side="right")) - 1)
            start, end = int(ends[row]), int(ends[upto])
            if upto == row + 1 and end - start > _BLOCK:
                span = _BLOCK
                while start < end:
                    stop = min(end, start + span)
                    while stop < end and (data[stop] & 0xC0) == 0x80:
                        stop += 1
                    piece = data[start:stop]
                    ids, n, read = self._stretch(piece, np.array([0]), np.array([len(piece)]), stop == end)
                    if stop < end and read == len(piece):
                        span *= 2  # no place to cut
                        continue
                    yield row, ids, n, start + read == end
                    start += read
            else:
                full = np.flatnonzero(np.diff(ends[row : upto + 1]))
                n = np.zeros(upto - row, np.int64)
                ids = np.zeros(0, self.dtype)
                if len(full):
                    ids, n[full], _ = self._stretch(data[start:end], ends[row + full] - start, ends[row + full + 1] - start, True)
                yield row, ids, n, True
            row = upto


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False, cache: int = CACHE) -> Encoder:
    """One for each worker process, file and bound of the cache."""
    return Encoder(path, cache, added)


def documents(texts: pa.Array, path: str, end_id: int = END_ID, added: bool = False, encode: Encoder | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with the end id) of every text, in order; with `added`, literals of added tokens are their ids."""
    encode = encode or (encoder(path, True) if added else encoder(path))
    end = np.array([end_id], encode.dtype)
    held: list[np.ndarray] = []
    for row, ids, sizes, last in encode.encode(texts):
        if held or not last:
            held.append(ids)
            if last:
                yield row, np.concatenate([*held, end])
                held = []
            continue
        cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
        for k in range(len(sizes)):
            yield row + k, np.concatenate((ids[cuts[k] : cuts[k + 1]], end))
