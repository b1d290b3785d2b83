"""Minimal perfect hashing by cascaded collision-free bit arrays, in numpy.

Level by level the keys that are left are hashed into an array of ``GAMMA`` slots a key; keys that
meet nobody take their slot, the others go on. A key's index is the rank of its bit over all levels,
so ``n`` keys get exactly the indices 0 .. n-1. Keys outside the set get an arbitrary index or -1:
callers hold full keys in the slots and compare bytes.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of xor-shifts and odd multipliers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


def fold_bytes(keys: list[bytes]) -> np.ndarray:
    """64-bit fingerprints of byte strings of any length."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class MinimalPerfectHash:
    """``levels``: for each level its size, packed bits and the ranks before each byte."""

    def __init__(self, fingerprints: np.ndarray):
        left = np.asarray(fingerprints, np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("fingerprints must be distinct")
        self.n, self.levels, before = len(left), [], 0
        while len(left):
            if len(self.levels) == MAX_LEVELS:
                raise ValueError("too many levels")
            size = max(8, int(GAMMA * len(left)) + 1)
            at = (mix(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            ranks = before + np.concatenate(([0], np.cumsum(alone)[:-1]))
            self.levels.append((size, np.packbits(alone), ranks[::8].astype(np.int64)))
            before += int(alone.sum())
            left = left[~alone[at]]

    def lookup(self, fingerprints: np.ndarray) -> np.ndarray:
        x = np.asarray(fingerprints, np.uint64)
        out, left = np.full(len(x), -1, np.int64), np.arange(len(x))
        for level, (size, bits, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = (mix(x[left], level) % np.uint64(size)).astype(np.int64)
            byte = bits[at >> 3]
            hit = (byte >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            # set bits of the byte before this one
            head = (byte.astype(np.int64) >> (8 - (at & 7)))
            rank = ranks[at >> 3] + _ONES[head]
            out[left[hit]] = rank[hit]
            left = left[~hit]
        return out


_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
