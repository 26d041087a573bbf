"""A Bloom filter with a bounded size, built in Spark from 64-bit keys and tested in tasks.

It only spares shuffles: what passes it is always checked by a join, so its size never changes a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


def build(keys: DataFrame, key: Column, n: int) -> np.ndarray:
    """Words of the filter of ``n`` long ``key`` values: 12 bits for each, within the bounds; two places of each key."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (12 * n).bit_length()))
    places = F.explode(F.array(key.bitwiseAND(bits - 1), F.shiftrightunsigned(key, 32).bitwiseAND(bits - 1)))
    words = keys.select(places.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value"))
    return common.packed(words, bits >> 6, "int64").view(np.uint64)


def may_have(words: np.ndarray, key: int) -> bool:
    """``key``: the 64 bits of the long, signed or not."""
    most = (len(words) << 6) - 1
    return all(int(words[b >> 6]) >> (b & 63) & 1 for b in (key & most, (key & 0xFFFFFFFFFFFFFFFF) >> 32 & most))
