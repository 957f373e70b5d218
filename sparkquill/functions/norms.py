"""Document-length quantisation and BM25 factors, as plain numbers and as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised_length(n: int) -> int:
    """The largest of 256 representable lengths that is no more than n: exact below 40, then three bits of precision."""
    if n < 40:
        return n
    m = n - 24
    s = m.bit_length() - 4
    return 24 + ((m >> s) << s)


def quantised_length_col(n: Column) -> Column:
    m = n - 24
    # 64 - leading zeros of a positive integer is the length of its binary form
    s = F.length(F.bin(m)) - 4
    unit = F.pow(F.lit(2.0), s)
    return F.when(n < 40, n).otherwise((F.lit(24) + F.floor(m / unit) * unit).cast("long")).cast("long")


def idf(n_docs: float, df: float) -> float:
    without = n_docs - df
    return math.log1p((without + 0.5) / (df + 0.5))


def idf_col(n_docs: Column, df: Column) -> Column:
    without = n_docs - df
    return F.log1p((without + 0.5) / (df + 0.5))


def tf_col(tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    norm = k1 * ((1 - b) + b * length / average)
    return (k1 + 1) * tf / (norm + tf)
