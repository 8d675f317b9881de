"""Anchors for 64-bit fingerprints: a covering code on two blocks of 23 bits.

The binary Golay code of length 23 has 4096 words and covers every 23-bit vector within
distance 3, each by exactly one word. An anchor is a pair of code words for bits 0-22 and
23-45; the other 18 bits don't choose anchors. A fingerprint's home is its pair of nearest words.
A fingerprint within t bits of another lies, in block 1 within 3 + i and in block 2 within 3 + j
of that one's home, where i + j <= t: these are the anchors it visits.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, RADIUS = 23, 3
#: Generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
_MASK = np.uint64((1 << LENGTH) - 1)


@lru_cache(maxsize=1)
def code_words() -> np.ndarray:
    words = np.zeros(4096, np.uint32)
    for shift in range(12):
        words[(np.arange(4096) >> shift) & 1 == 1] ^= np.uint32(GENERATOR << shift)
    return words


def _flips(most: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(LENGTH), n)]


@lru_cache(maxsize=1)
def homes() -> np.ndarray:
    """Index of the nearest code word of each 23-bit vector."""
    nearest = np.zeros(1 << LENGTH, np.uint16)
    for flip in _flips(RADIUS):
        nearest[code_words() ^ np.uint32(flip)] = np.arange(4096, dtype=np.uint16)
    return nearest


@lru_cache(maxsize=4)
def reach(most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each way to differ from the home (2048 of them, by position in _flips): code words, as
    differences from the home, and the flips that it takes to get there; padded with flips over `most`."""
    rows = []
    for error in _flips(RADIUS):
        seen: dict[int, int] = {}
        for flip in _flips(most):
            word = int(homes()[error ^ flip])
            seen.setdefault(word, flip.bit_count())
        rows.append(sorted(seen.items(), key=lambda x: (x[1], x[0])))
    width = max(map(len, rows))
    words, levels = np.zeros((len(rows), width), np.uint16), np.full((len(rows), width), most + 1, np.uint8)
    for i, row in enumerate(rows):
        words[i, : len(row)] = [w for w, _ in row]
        levels[i, : len(row)] = [n for _, n in row]
    return words, levels


@lru_cache(maxsize=1)
def _error_index() -> dict[str, np.ndarray]:
    flips = np.array(_flips(RADIUS), np.uint32)
    order = np.argsort(flips)
    return {"sorted": flips[order], "index": order}


def _block(fingerprints: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Home word and index of the difference from it, for 23 bits from `at`."""
    bits = ((fingerprints >> np.uint64(at)) & _MASK).astype(np.uint32)
    home = homes()[bits]
    errors = _error_index()
    return home, errors["index"][np.searchsorted(errors["sorted"], bits ^ code_words()[home])]


def home_anchor(fingerprints: np.ndarray) -> np.ndarray:
    a, _ = _block(fingerprints, 0)
    b, _ = _block(fingerprints, LENGTH)
    return a.astype(np.int64) << 12 | b


def visited_anchors(fingerprints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor that a fingerprint visits for distance `most`; its home is one."""
    words, levels = reach(most)
    a, ea = _block(fingerprints, 0)
    b, eb = _block(fingerprints, LENGTH)
    # The code is linear and a word's index is its message, so words differ as their indices do.
    left, right = a[:, None] ^ words[ea], b[:, None] ^ words[eb]
    fits = levels[ea][:, :, None] + levels[eb][:, None, :] <= most
    row, i, j = np.nonzero(fits)
    return row, left[row, i].astype(np.int64) << 12 | right[row, j]
