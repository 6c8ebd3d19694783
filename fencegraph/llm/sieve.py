"""Bitmaps of keys, of bounded size: what is a key passes, what is none mostly does not."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 15, 27  # 16 MB at most


class Sieve:
    """The place of a 64-bit key is its leading bits, crossed with its last ones."""

    def __init__(self, bits: int, data: bytes) -> None:
        self.bits, self.data = bits, np.frombuffer(data, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """For keys as unsigned numbers."""
        at = (keys >> np.uint64(64 - self.bits)) ^ (keys & np.uint64((1 << self.bits) - 1))
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sieve(keys: DataFrame, key: str, most_bits: int = MOST_BITS, bits_per_key: int = BITS_PER_KEY) -> Sieve:
    """Of a column of (signed) keys. Only the bitmap comes to the driver: never more than 2^most_bits bits."""
    bits = min(most_bits, max(LEAST_BITS, (bits_per_key * max(1, keys.count()) - 1).bit_length()))
    place = F.shiftrightunsigned(F.col(key), 64 - bits).bitwiseXOR(F.col(key).bitwiseAND(F.lit((1 << bits) - 1))) + 1  # the bitmap functions count from one
    maps = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    data = bytearray(1 << bits - 3)
    for r in maps.collect():
        data[(r.b - 1) * 4096 : r.b * 4096] = r.m
    return Sieve(bits, bytes(data))
