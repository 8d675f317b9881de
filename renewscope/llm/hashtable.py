"""A frozen map from 64-bit keys to rows of numbers, looked up for whole arrays at once."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class FrozenMap:
    """Open addressing with linear steps; at most half of the slots are filled."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys) - 1).bit_length() if len(keys) else 4)
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at = np.full(1 << bits, -1, np.int32)
        self.values = values
        left, slot = np.arange(len(keys)), self._slot(keys.astype(np.uint64))
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several for one slot the last one stays
            self.keys[slot[free]] = keys[left[free]]
            placed = self.at[slot] == left
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for keys that the map doesn't hold."""
        slot = self._slot(keys)
        found = self.at[slot]
        other = np.flatnonzero((self.keys[slot] != keys) & (found >= 0))
        slot = slot[other]
        while len(other):
            slot = (slot + 1) & self.mask
            row = self.at[slot]
            done = (row < 0) | (self.keys[slot] == keys[other])
            found[other[done]] = row[done]
            other, slot = other[~done], slot[~done]
        return found
