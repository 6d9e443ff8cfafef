"""A numpy hash table from 64-bit keys to 32-bit values, looked up for whole arrays at once."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class HashTable:
    """Open addressing with linear probing; at most half full; absent keys give -1. Keys must not be 2^64 - 1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << bits, -1, np.int32)
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # each round the first key of every free slot gets in
            at = slot[todo]
            free = self.values[at] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], values[todo[put]]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        todo = np.flatnonzero((out == -1) & (self.values[slot] != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at, k = slot[todo], keys[todo]
            hit = self.keys[at] == k
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (self.values[at] != -1)]
        return out
