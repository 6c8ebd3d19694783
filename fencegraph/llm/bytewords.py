"""Words as places in one byte array: hashes and comparisons by array operations, eight bytes at a time."""

from __future__ import annotations

import numpy as np
import xxhash

_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LONG = 4096  # bytes of a word that is hashed apart


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Bytes:
    """A byte array with the eight bytes from each place on as a number."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))
        self.eight = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))

    def hashes(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        length = end - start
        h = np.full(len(length), seed, np.uint64) + length.astype(np.uint64)
        at, left = np.arange(len(length)), length
        large = np.flatnonzero(length > _LONG)
        if len(large):
            at = np.flatnonzero(length <= _LONG)
            left = length[at]
        place = start[at]
        while len(at):
            h[at] = mix(h[at] ^ (self.eight[place] & _MASKS[np.minimum(left, 8)]))
            more = left > 8
            at, left, place = at[more], left[more] - 8, place[more] + 8
        for i in large:
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(self.data[start[i] : end[i]].tobytes()))
        return h

    def equal(self, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
        """Whether the words from ``start`` to ``end`` are those from ``other`` to ``other_end``."""
        same = end - start == other_end - other
        at = np.flatnonzero(same)
        a, b, left = start[at], other[at], (end - start)[at]
        while len(at):
            unequal = ((self.eight[a] ^ self.eight[b]) & _MASKS[np.minimum(left, 8)]) != 0
            same[at[unequal]] = False
            more = (left > 8) & ~unequal
            at, a, b, left = at[more], a[more] + 8, b[more] + 8, left[more] - 8
        return same


def words_between(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``part`` does not hold."""
    edge = np.diff(np.concatenate(([0], (~part).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
