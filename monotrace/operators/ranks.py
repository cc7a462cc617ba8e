"""Dense ranks of columns in memory, for tables and samples whose size is bounded, and verdicts from them.

A violation among some rows is one of the whole table, so a bounded sample refutes; it never confirms.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import sort_key

#: Rows of a sample at most, and bytes of a row that may be in one: 40 MB in all.
SAMPLE_ROWS, ROW_BYTES = 20_000, 2_000


def row_bytes(df: DataFrame, columns: Sequence[str]) -> Column:
    """What a row's values take: texts their bytes, all else 8."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    return sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in texts), F.lit(8 * len(columns))).cast("long")


def sampled(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """Up to SAMPLE_ROWS rows of at most ROW_BYTES each; spread over the table where its number of rows is told, else the first ones."""
    if rows is not None and rows > 2 * SAMPLE_ROWS:
        df = df.sample(fraction=2 * SAMPLE_ROWS / rows, seed=7)
    return df.where(row_bytes(df, columns) <= ROW_BYTES).limit(SAMPLE_ROWS)


def dense_ranks(values) -> np.ndarray:
    """Ranks of an Arrow array from 0 in Spark's order: null, numbers or texts, NaN; equal values share one."""
    nulls = values.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros(len(nulls), np.int32)
    known = values.drop_null()
    if len(known):
        if str(known.type).startswith("string"):  # each text once, in order of its bytes
            each = known.dictionary_encode()
            order = np.argsort(np.array([s.encode() for s in each.dictionary.to_pylist()], object), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            codes = place[each.indices.to_numpy(zero_copy_only=False)]
        else:
            codes = np.unique(known.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        out[~nulls] = codes + bool(nulls.any())
    return out


def distinct_rows(ranks: np.ndarray) -> np.ndarray:
    """The same columns without repeated rows, which show no violation that the first of them does not."""
    codes, first = np.zeros(ranks.shape[1], np.int64), np.arange(min(1, ranks.shape[1]))
    for column in ranks:
        _, first, codes = np.unique(codes * (int(column.max(initial=0)) + 1) + column, return_index=True, return_inverse=True)
        if len(first) == ranks.shape[1]:
            return ranks
    return np.ascontiguousarray(ranks[:, np.sort(first)])


def encode(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Ranks of the columns over the distinct rows, one row a column; the caller has bounded the size."""
    table = df.select(*(sort_key(df, c).alias(f"k{i}") for i, c in enumerate(columns))).toArrow()
    return distinct_rows(np.array([dense_ranks(table.column(i).combine_chunks()) for i in range(len(columns))], np.int32).reshape(len(columns), -1))


class Ranked:
    """Verdicts from ranks. Ranks of column lists are kept while a batch is worked on."""

    def __init__(self, ranks: np.ndarray):
        self.ranks, self.lists = ranks, {}

    def of(self, columns: tuple[int, ...]) -> tuple[np.ndarray, int]:
        """Dense ranks of the rows by a list of columns, and how many there are."""
        if columns not in self.lists:
            if len(self.lists) > 64:
                self.lists.clear()
            last = self.ranks[columns[-1]].astype(np.int64)
            key = last if len(columns) == 1 else self.of(columns[:-1])[0] * (int(last.max(initial=0)) + 1) + last
            values, codes = np.unique(key, return_inverse=True)
            self.lists[columns] = codes.astype(np.int64), len(values)
        return self.lists[columns]

    def verdict(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[bool, bool, bool]:
        """Order compatible, x orders y, y orders x: no swap among the distinct pairs; and as many pairs as values of the side that orders."""
        (a, na), (b, nb) = self.of(x), self.of(y)
        pairs = np.unique(a * max(nb, 1) + b)
        right = pairs % max(nb, 1)
        if (right[1:] < right[:-1]).any():
            return False, False, False
        return True, len(pairs) == na, len(pairs) == nb


def refuted(df: DataFrame, x: Sequence[str], y: Sequence[str], splits_matter: bool) -> bool:
    """Whether the first rows alone show that X does not order Y, or, without splits, that the two are not compatible."""
    names = list(dict.fromkeys([*x, *y]))
    ocd, od, _ = Ranked(encode(sampled(df, names), names)).verdict(tuple(names.index(c) for c in x), tuple(names.index(c) for c in y))
    return not (od if splits_matter else ocd)
