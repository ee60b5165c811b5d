"""Bitmaps of hashes, of fixed size: what they hold may be in the set, what they don't is not."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits for the top bits of the 64-bit column h; at most 2^(bits - 6) rows reach the driver, however many hashes there are."""
    low = 64 - bits
    words = hashes.groupBy(F.shiftrightunsigned("h", low + 6).cast("int").alias("w"))
    found = words.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {low}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash whether its bit is set."""
    place = hashes >> np.uint64(64 - (len(bitmap).bit_length() + 5))
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
