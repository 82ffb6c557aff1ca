"""Bitmaps of a fixed size over 64-bit keys: which keys may be in a table.

A key marks the bit of its number modulo the bitmap's size, so a key of the
table always tests true and others now and then do too.  What reaches the
driver and the executors is bounded by the size, whatever the table holds; a
table with more keys than bits only makes the test less selective.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27  # 16 MB
_BUCKET = 1 << 15  # bits in a row of Spark's bitmap aggregate


def bitmap(keys: DataFrame, key: Column, bits: int = BITS) -> np.ndarray:
    """Bitmap (bytes, low bit first) of the keys in ``keys``; ``bits`` is a multiple of 32768."""
    place = F.pmod(key, F.lit(bits)) + 1  # the aggregate counts from 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bytes")).where("bucket is not null")
    out = np.zeros(bits // 8, "u1")
    for r in rows.toLocalIterator():  # at most bits / 32768 rows of 4 KB
        part = np.frombuffer(r["bytes"], "u1")
        at = (r["bucket"] - 1) * (_BUCKET // 8)
        out[at:at + len(part)] = part
    return out


def marked(of: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (signed 64-bit) may be in the bitmap's table."""
    place = keys % np.int64(len(of) * 8)  # numpy's remainder of a positive number is not negative, like pmod
    return (of[place >> 3] >> (place & 7).astype("u1")) & 1 == 1
