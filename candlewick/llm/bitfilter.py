"""Filters of fixed size over hashed keys (their lowest 40 bits count): no key is
missed, a few others pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.textscan import U

#: Bits of a filter, whatever the number of keys.  More keys let more others pass.
FILTER_BITS = 1 << 24


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key`` (bigint): FILTER_BITS / 64 words at most come to the driver."""
    key = F.col("key")
    bits = keys.select(
        F.explode(
            F.array(
                F.shiftrightunsigned(key, 16).bitwiseAND(F.lit(FILTER_BITS - 1)),
                key.bitwiseAND(F.lit(FILTER_BITS - 1)),
            )
        ).alias("bit")
    )
    word = F.shiftright("bit", 6).alias("word")
    got = bits.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for row in got.toLocalIterator():
        table[row["word"]] = row["bits"]
    return table.view(U)


def _holds(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) > 0


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64-bit unsigned) the filter lets pass."""
    out = _holds(table, (keys >> U(16)) & U(FILTER_BITS - 1))
    at = np.flatnonzero(out)
    out[at] = _holds(table, keys[at] & U(FILTER_BITS - 1))
    return out
