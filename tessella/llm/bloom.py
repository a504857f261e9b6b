"""A test of membership with a bounded broadcast, to keep rows that surely have no partner out of a shuffle.

One bit per hashed id: at most MAX_BITS bits are broadcast, whatever the number of ids. A row that the test lets through
may still have no partner: an exact join always follows. With more ids than bits the test lets nearly all rows through,
and the join costs what it would cost without it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ID = 16
MAX_BITS = 1 << 27  # 16 MB
_PART = 32_768  # bits of one value of bitmap_construct_agg


def membership(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A function of a column of ids that is true for all ids of the table and for few others; false for null."""
    spark = ids.sparkSession
    n = ids.count()
    bits = min(MAX_BITS, max(_PART, 1 << (max(1, n) * BITS_PER_ID - 1).bit_length()))

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("member"), c), F.lit(bits))

    at = place(F.col(column))
    parts = ids.where(F.col(column).isNotNull()).groupBy(F.floor(at / _PART).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(_PART))).alias("bitmap"))
    table = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts.collect():  # MAX_BITS / 8 bytes at most
        table[r["part"] * (_PART // 8) : (r["part"] + 1) * (_PART // 8)] = np.frombuffer(r["bitmap"], dtype=np.uint8)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def test(places: pd.Series) -> pd.Series:
        p = places.to_numpy(dtype=np.int64)
        return pd.Series((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

    return lambda c: F.coalesce(c.isNotNull() & test(F.coalesce(place(c), F.lit(0))), F.lit(False))
