"""A fixed int64 → int64 map with vectorised lookups (open addressing)."""

from __future__ import annotations

import numpy as np

_EMPTY = np.int64(-1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """Keys are distinct and not negative."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY, dtype=np.int64)
        self.values = np.zeros(1 << bits, dtype=np.int64)
        keys, values = keys.astype(np.int64), values.astype(np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == _EMPTY
            # one key per free slot goes in, the others probe on
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            put = np.zeros(len(keys), dtype=bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], at[~put]
            at = np.where(self.keys[at] == _EMPTY, at, (at + 1) & self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        shape, keys = keys.shape, keys.ravel()
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], missing)
        todo = np.flatnonzero((found != keys) & (found != _EMPTY))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            found, want = self.keys[at], keys[todo]
            hit = found == want
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != _EMPTY)
            todo, at = todo[on], at[on]
        return out.reshape(shape)
