"""A bit filter of bounded size: which rows of a large table are worth a shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits set for the column ``token`` of ``hashes``: at most ``bits / 64`` rows reach the driver, however long the column is."""
    slot = F.expr(f"token & {bits - 1}L")
    rows = (
        hashes.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast((token & {bits - 1}L) & 63 as int))").alias("bit"))
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    )
    out = np.zeros(bits // 64, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_filter(hashes: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(filter_) * 64 - 1)
    return (filter_[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def listed(hashes: DataFrame, column: Column, bits: int = 1 << 22) -> Column:
    """Condition on a column of 64-bit hashes: true for every ``token`` of ``hashes``, and for few others while the filter isn't full."""
    shared = hashes.sparkSession.sparkContext.broadcast(bit_filter(hashes, bits))

    @F.pandas_udf("boolean")
    def test(tokens: pd.Series) -> pd.Series:
        return pd.Series(in_filter(tokens.to_numpy(np.int64).view(np.uint64), shared.value), index=tokens.index)

    return test(column)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` isn't among the keys of ``gone``; rows with a null key stay.

    Only rows that the bit filter holds back are shuffled to be compared exactly.
    """
    token = F.xxhash64(key)
    held = listed(gone.select(token.alias("token")), token)
    return rows.filter(~held).unionByName(rows.filter(held).join(gone.select(key).distinct(), key, "left_anti"))
