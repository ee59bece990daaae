"""A minimal perfect hash over 64-bit keys, as flat arrays that ship as bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Slots for each key of a level; more make fewer levels and longer arrays.
ROOM = 2.0
LEVELS = 64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Level by level, a key alone in its slot stays; the others go on to the next level.

    ``words`` holds one bit for each slot of all levels, ``ranks`` the number
    of set bits before each word, so a key's number is the rank of its bit.
    """

    sizes: list[int]
    words: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, bits = np.asarray(keys, np.uint64), [], []
        while left.size:
            if len(sizes) == LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = -(-int(left.size * ROOM) // 64) * 64
            slots = (mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slots, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[slots]]
        words = np.packbits(np.concatenate(bits), bitorder="little").view(np.uint64) if bits else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]) if bits else np.zeros(0, np.int64)
        return cls(sizes, words, ranks.astype(np.int64))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number from 0 up; a key that was not built in gets any number or -1."""
        keys = np.asarray(keys, np.uint64)
        out, open_, start = np.full(keys.size, -1, np.int64), np.arange(keys.size), 0
        for level, size in enumerate(self.sizes):
            slots = (mix(keys[open_], level + 1) % np.uint64(size)).astype(np.int64) + start
            word, bit = self.words[slots >> 6], (slots & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.ranks[slots[hit] >> 6] + np.bitwise_count(below)
            open_, start = open_[~hit], start + size
            if not open_.size:
                break
        return out
