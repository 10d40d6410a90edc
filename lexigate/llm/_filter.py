"""A filter of bits that picks, where texts are read, the rows worth a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 2 MB whatever the input. A full filter only lets more rows through.
FILTER_BITS = 1 << 24


def _place(h: Column) -> Column:
    return F.shiftright(h.bitwiseAND(F.lit(FILTER_BITS - 1)), 6)


def bit_words(hashes: DataFrame) -> DataFrame:
    """(i, w): a bit for the low bits of each hash (the only column); at most FILTER_BITS / 64 rows."""
    h = hashes.columns[0]
    return hashes.groupBy(_place(F.col(h)).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{h}` & 63 as int))")).alias("w"))


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """The words of ``bit_words`` as an array, to be sent to Python tasks."""
    rows = bit_words(hashes).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column("i").to_numpy()] = rows.column("w").to_numpy()
    return out


def marked(df: DataFrame, words: DataFrame, h: str) -> DataFrame:
    """``df`` with hit_: whether the bit of column ``h`` is set in ``words``, which are broadcast."""
    own = df.withColumn("i_", _place(F.col(h)))
    joined = own.join(F.broadcast(words.select(F.col("i").alias("i_"), F.col("w").alias("w_"))), "i_", "left")
    hit = F.expr(f"shiftright(w_, cast(`{h}` & 63 as int)) & 1L") == 1
    return joined.withColumn("hit_", F.coalesce(hit, F.lit(False))).drop("i_", "w_")


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices of the hashes whose bit is set."""
    bit = (hashes.view(np.uint64) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return np.flatnonzero((words[bit >> 6] >> (bit & 63)) & 1)
