"""Hashes of words and of character n-grams inside words, for whole batches of texts.

A text's bytes are mapped so that all bytes outside words are one separator. A word's n-grams
include one separator on either side of it; characters are UTF-8 characters. A hash is a
polynomial in the bytes, taken from prefix sums modulo 2 ** 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from renewscope.llm.common import blocks, powers, utf8

SEPARATOR = 0x20
#: Kinds of features.
WORDS, PREFIXED, GRAMS, AGAIN = 1, 2, 3, 4
_BLOCK = 1 << 18
_BASE = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Words end at white space; letters keep their case.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[[*range(0x09, 0x0E)]] = SEPARATOR
#: Words are runs of letters, digits and bytes of other scripts; A-Z count as a-z.
LETTERED = np.full(256, SEPARATOR, np.uint8)
LETTERED[48:58], LETTERED[97:123], LETTERED[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
LETTERED[65:91] = np.arange(97, 123)


def features(texts: pa.Array, mapped: np.ndarray, sizes: tuple[int, ...], prefixes: tuple[int, ...] = (), again: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, rows, 64-bit hashes) of every occurrence of a word, of its n-grams of `sizes` characters and of its
    first `prefixes` characters; with `again` also one hash for every word that is the word before it.
    In parts of bounded size; hashes of different kinds are kept apart."""
    data, ends = utf8(texts)
    for rows, starts, stops in blocks(ends, _BLOCK, data, mapped == SEPARATOR):
        lengths = stops - starts + 2
        after = np.cumsum(lengths)
        stream = np.full(int(after[-1]), SEPARATOR, np.uint8)
        for start, stop, end in zip(starts.tolist(), stops.tolist(), after.tolist()):
            stream[end - (stop - start) - 1 : end - 1] = mapped[data[start:stop]]
        yield from _hashed(stream, after, rows, sizes, prefixes, again)


def _hashed(stream: np.ndarray, after: np.ndarray, rows: np.ndarray, sizes: tuple[int, ...], prefixes: tuple[int, ...], again: bool):
    up, down = powers(_BASE, max(2 * _BLOCK, 1 << len(stream).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(stream) + 1, np.uint64)
        np.cumsum((stream.astype(np.uint64) + np.uint64(1)) * up[: len(stream)], out=sums[1:])
        apart = stream == SEPARATOR
        edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        begin, finish = edge[::2], edge[1::2]  # a stream begins and ends with a separator
        row_of = lambda at: rows[np.searchsorted(after, at, side="right")]

        def kind(number: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
            h = (sums[last] - sums[first]) * down[first]
            h = (h + np.uint64(number)) * _MIX
            return (h ^ (h >> np.uint64(29))) * _MIX

        word_rows = row_of(begin)
        words = kind(WORDS, begin, finish)
        yield WORDS, word_rows, words
        if again:
            same = np.flatnonzero((words[1:] == words[:-1]) & (word_rows[1:] == word_rows[:-1]))
            yield AGAIN, word_rows[same], np.full(len(same), _MIX * np.uint64(AGAIN))
        chars = np.flatnonzero((stream & 0xC0) != 0x80)
        inner = np.concatenate(([0], np.cumsum(apart[chars], dtype=np.int32)))
        bounds = np.concatenate((chars, [len(stream)]))
        if prefixes:
            at = np.searchsorted(chars, begin)
            long = np.searchsorted(chars, finish) - at
            for n in prefixes:
                fits = long > n
                yield PREFIXED, word_rows[fits], kind(PREFIXED, begin[fits], bounds[at[fits] + n])
        for n in sizes:
            if len(chars) < n:
                continue
            whole = inner[n - 1 : len(inner) - 1] == inner[1 : len(inner) - n + 1]  # no separator inside
            at = np.flatnonzero(whole)
            first = chars[at]
            yield GRAMS, row_of(first), kind(GRAMS, first, bounds[at + n])
