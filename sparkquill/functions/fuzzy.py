"""Bounded edit distance in which swapping two neighbours is one edit (optimal string alignment)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def _rows(a: str, b: str):
    """Rows of the distance table of a (down) against b (across)."""
    two, one = [], list(range(len(b) + 1))
    yield one
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
        yield row


def osa_distance(a: str, b: str, most: int) -> int | None:
    """The distance if it is at most `most`, else None."""
    if abs(len(a) - len(b)) > most:
        return None
    row = [0]
    for row in _rows(a, b):
        if min(row) > most + 1:
            return None
    return row[-1] if row[-1] <= most else None


def osa_prefix_distance(prefix: str, word: str, most: int) -> int | None:
    """The least distance of prefix to a beginning of word whose length differs by at most `most`."""
    row = [0]
    for row in _rows(prefix, word[: len(prefix) + most]):
        pass
    near = row[max(0, len(prefix) - most) :]
    return min(near) if near and min(near) <= most else None


def near(column: Column, word: str, most: int) -> Column:
    """True for all strings within `most` edits of word, and few others: the built-in distance counts a swap as two."""
    if most == 1:
        swaps = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
        ok = F.levenshtein(column, F.lit(word), 1) >= 0
        return ok | column.isin(sorted(swaps)) if swaps else ok
    return F.levenshtein(column, F.lit(word), 2 * most) >= 0


def weight(distance: int) -> float:
    """What a fuzzy match counts of an exact one."""
    return {0: 1.0, 1: 0.8, 2: 0.6}.get(distance, max(0.2, 1 - 0.2 * distance))


def distance_udf(query: str, most: int, prefix: bool):
    """Arrow-batched distance of a column of terms to a query; null beyond `most`."""
    fn = osa_prefix_distance if prefix else osa_distance

    @F.pandas_udf(IntegerType())
    def distance(terms: pd.Series) -> pd.Series:
        return pd.Series([fn(query, t, most) for t in terms], dtype="Int32")

    return distance
