"""Minimal perfect hashing of 64-bit keys in numpy.

In every level the remaining keys choose a bit each; bits chosen once are taken, the keys of the
others go to the next level. The rank of its bit among all bits of all levels is the index of a
key. Keys that were not hashed get some index or none, so whoever looks up verifies the key there.
"""

from __future__ import annotations

import numpy as np

from stayrate.llm.kernels import mixed

#: Bits for every key that enters a level.
SPACE = 2
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_STEP = 0x9E3779B97F4A7C15


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    turned = mixed(keys + np.uint64((level + 1) * _STEP % (1 << 64)))
    return (turned % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> list[bytes]:
    """The bits of all levels for different ``keys`` (uint64)."""
    levels, rest = [], keys
    while len(rest):
        size = -(-SPACE * len(rest) // 64) * 64
        place = _place(rest, len(levels), size)
        alone = np.bincount(place, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        rest = rest[~alone[place]]
    return levels


class MinimalHash:
    """Indices from 0 without gaps for the keys that ``levels`` were built from."""

    def __init__(self, levels: list[bytes]):
        self.levels = []
        n = 0
        for bits in levels:
            taken = np.frombuffer(bits, np.uint8)
            before = np.concatenate(([0], np.cumsum(_ONES[taken], dtype=np.int64))) + n
            self.levels.append((taken, before[:-1]))
            n = int(before[-1])
        self.n = n

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of every key; -1 where no level has it."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (taken, before) in enumerate(self.levels):
            if not len(left):
                break
            place = _place(keys[left], level, len(taken) * 8)
            byte, bit = taken[place >> 3], (place & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            below = _ONES[byte & ((np.uint8(1) << bit) - np.uint8(1))]
            found[left[hit]] = before[place[hit] >> 3] + below[hit]
            left = left[~hit]
        return found
