"""Minimal perfect hash of a set of 128-bit keys, as one byte string that a table can hold.

Level by level, the keys still without a place are hashed into a bit array somewhat larger than
they are many; a key that is alone in its slot takes it, the others go on to the next level. A
key's number is the rank of its bit among all set bits, so n keys get the numbers 0 to n-1. Keys
that no level can part (equal first halves) are listed and found by binary search.

A key outside the set may get a number too; callers compare the fingerprint stored under it.
An empty set has no numbers.
"""

from __future__ import annotations

import struct

import numpy as np

#: Slots a key of each level, and the levels that are tried before the rest is listed.
GAMMA, LEVELS = 1.6, 48

_KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """A slot for every key: a bijective mix of the key and the level, reduced to the level's size."""
    x = keys + np.uint64(((level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build(first: np.ndarray, second: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The function's bytes and the number of every given key; keys (first, second) are distinct."""
    first, second = first.astype("<u8"), second.astype("<u8")
    left, sizes, arrays = np.arange(len(first)), [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-int(len(left) * GAMMA + 1) // 64) * 64
        slots = _slots(first[left], level, size)
        alone = np.bincount(slots, minlength=size)[slots] == 1
        bits = np.zeros(size, np.uint8)
        bits[slots[alone]] = 1
        sizes.append(size)
        arrays.append(np.packbits(bits, bitorder="little"))
        left = left[~alone]
    rest = np.sort(np.array(list(zip(first[left], second[left])), _KEY))
    packed = struct.pack("<III", len(first), len(sizes), len(rest)) + np.array(sizes, "<u4").tobytes()
    packed += b"".join(a.tobytes() for a in arrays) + rest.tobytes()
    return packed, PerfectHash(packed).numbers(first, second)


class PerfectHash:
    """The function read back from its bytes."""

    def __init__(self, packed: bytes):
        self.count, levels, rest = struct.unpack_from("<III", packed)
        self.sizes = np.frombuffer(packed, "<u4", levels, 12).tolist()
        at = 12 + 4 * levels
        words = np.frombuffer(packed, "<u8", sum(self.sizes) // 64, at)
        self.words = words
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        self.rest = np.frombuffer(packed, _KEY, rest, at + 8 * len(words))

    def numbers(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Every key's number, -1 where no bit and no listed key answers."""
        first, second = first.astype("<u8"), second.astype("<u8")
        found, left, base = np.full(len(first), -1, np.int64), np.arange(len(first)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                return found
            slots = _slots(first[left], level, size)
            words, shift = base + slots // 64, (slots % 64).astype(np.uint64)
            bit = np.uint64(1) << shift
            held = (self.words[words] & bit) != 0
            w = words[held]
            below = np.bitwise_count(self.words[w] & (bit[held] - np.uint64(1)))
            found[left[held]] = self.ranks[w] + below
            left, base = left[~held], base + size // 64
        if len(left) and len(self.rest):
            keys = np.empty(len(left), _KEY)
            keys["a"], keys["b"] = first[left], second[left]
            at = np.searchsorted(self.rest, keys)
            same = self.rest[np.minimum(at, len(self.rest) - 1)] == keys
            found[left[same]] = self.ranks[-1] + at[same]
        return found
