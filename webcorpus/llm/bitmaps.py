"""Fixed-size membership filters for keys that are 64-bit hashes.

A filter of 2**26 bits (8 MB) is built by one aggregate over bitmap buckets,
so what reaches the driver and is broadcast has the same size for any input.
Filters only spare rows: every use is followed by an exact join or count.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 26
_BUCKET = 32768  # bits of one value of bitmap_construct_agg


class Filter:
    """``filter.holds(keys)`` for an array of int64 or uint64 keys; false positives only."""

    def __init__(self, spark: SparkSession, bits: np.ndarray):
        self._bits = spark.sparkContext.broadcast(bits)
        self._mask = np.uint64(8 * len(bits) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bits = self._bits.value
        at = keys.astype(np.uint64) & self._mask
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

    def release(self) -> None:
        """Free the bits on the driver and the executors, once all that is filtered by them is written."""
        self._bits.destroy()


def key_filter(keys: DataFrame, key: str, n_bits: int = BITS) -> Filter:
    """A filter of the values of the long column ``key``, whose low bits must be well mixed. Few keys can do with fewer bits."""
    at = F.col(key).bitwiseAND(F.lit((1 << n_bits) - 1))
    buckets = (
        keys.groupBy(F.floor(at / _BUCKET).alias("bucket"))
        .agg(F.bitmap_construct_agg(at % _BUCKET).alias("bits"))
        .collect()  # at most 2**26 / 32768 = 2048 rows of 4 KB
    )
    bits = np.zeros((1 << n_bits) // 8, np.uint8)
    for row in buckets:
        start = row["bucket"] * (_BUCKET // 8)
        bits[start : start + _BUCKET // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(keys.sparkSession, bits)


def mixed_id(ids: np.ndarray) -> np.ndarray:
    """Document ids as filter keys, as ``mixed_id_column`` gives them."""
    x = ids.astype(np.int64).view(np.uint64)
    return x ^ (x >> np.uint64(BITS))
