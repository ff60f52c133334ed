"""A filter of fixed size for ids: a broadcast bitmap that lets some others pass, never loses one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24


def build(ids: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bitmap (2^bits bits) of the one long column of ids. What reaches the driver has 2^(bits - 6) rows at most."""
    x = F.col(ids.columns[0])
    place = F.xxhash64(x).bitwiseAND((1 << bits) - 1)
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("w"))
    out = np.zeros(1 << bits - 6, dtype=np.uint64)
    got = words.toPandas()
    out[got["i"].to_numpy(np.int64)] = got["w"].to_numpy(np.int64).view(np.uint64)
    return out


def place(column: str, bits: int = BITS):
    """The bit of an id, as a column to look up with has()."""
    return F.xxhash64(F.col(column)).bitwiseAND((1 << bits) - 1)


def has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    p = places.astype(np.int64)
    return (bitmap[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
