"""Neighbours within ranges of rows in order, compared in Arrow batches, so that the shuffle that makes the ranges is the only one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import sort_key


def plain_key(df: DataFrame, name: str) -> Column:
    """The sort key of a column; whole numbers of any width, dates and timestamps as long, truth values as byte."""
    key, kind = sort_key(df, name), df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key)
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("long")
    if isinstance(kind, T.BooleanType):
        return key.cast("byte")
    return key.cast("long") if isinstance(kind, T.IntegralType) else key


def signs(before: Sequence[pa.Array], after: Sequence[pa.Array]) -> np.ndarray:
    """-1, 0, 1 for each row as the list `before` lies below, at or above the list `after`: nulls first, NaN last, texts by bytes."""
    out = np.zeros(len(before[0]), np.int8)
    for a, b in zip(before, after, strict=True):
        plain = lambda v: v.to_numpy(zero_copy_only=False)
        if pa.types.is_floating(a.type):
            x, y = plain(a.fill_null(0)), plain(b.fill_null(0))
            less, more = (x < y) | (np.isnan(y) & ~np.isnan(x)), (x > y) | (np.isnan(x) & ~np.isnan(y))
        else:
            less, more = (plain(pc.fill_null(test(a, b), False)) for test in (pc.less, pc.greater))
        no_a, no_b = plain(a.is_null()).astype(np.int8), plain(b.is_null()).astype(np.int8)
        sign = np.where(no_a | no_b, no_b - no_a, more.astype(np.int8) - less.astype(np.int8))
        out = np.where(out == 0, sign, out).astype(np.int8)
    return out


def with_rows_before(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[pa.Array], bool]]:
    """Each batch's columns, the same of the rows before them, and whether the first row has none before it, and is given itself."""
    last = None
    for batch in batches:
        if batch.num_rows:
            now = batch.columns
            before = [pa.concat_arrays([c.slice(0, 1) if last is None else last[k], c.slice(0, len(c) - 1)]) for k, c in enumerate(now)]
            yield now, before, last is None
            # copies: a slice would keep its batch
            last = [c.take(pa.array([len(c) - 1])) for c in now]


def first_violations(x: int, splits_matter: bool, most: int, longest: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over groups (lo, hi: `x` columns each) in order: a row a range (part, bad, wide, its first lo, its last hi).

    Of a range with a violation nothing more is read, and it gives `most` rows, so that a limit to so many rows is met by it alone. A range
    whose two border values take more than `longest` bytes gives nulls in their place, and is `wide`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        names = ["part", "bad", "wide", *(f"lo{i}" for i in range(x)), *(f"hi{i}" for i in range(x))]
        part = TaskContext.get().partitionId()
        told = lambda bad, wide, values, n=1: pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([bad] * n), pa.array([wide] * n), *values], names)
        for now, before, starts in with_rows_before(batches):
            lo, hi = now[:x], now[x:]
            wrong = signs(before[x:], lo) > 0
            if starts:
                wrong[0] = False
            if splits_matter:
                wrong |= signs(lo, hi) != 0
            if wrong.any():
                yield told(True, False, [pa.nulls(most, c.type) for c in now], most)
                return
            first = [c.take(pa.array([0])) for c in lo] if starts else first
            last = hi
        if first is not None:
            values = [*first, *(c.take(pa.array([len(c) - 1])) for c in last)]
            wide = longest is not None and sum(v.nbytes for v in values) > longest
            yield told(False, wide, [pa.nulls(1, v.type) for v in values] if wide else values)

    return run


def neighbours_counted(x: int, y: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows (n, x columns, y columns) in order: part, n, splits, swaps, back_splits, its first and its last row of each n in a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        firsts: dict[int, list[pa.Array]] = {}
        lasts: dict[int, list[pa.Array]] = {}
        for now, before, starts in with_rows_before(batches):
            n, was = (c[0].to_numpy(zero_copy_only=False) for c in (now, before))
            on_x, on_y = signs(before[1 : 1 + x], now[1 : 1 + x]), signs(before[1 + x :], now[1 + x :])
            same = n == was
            if starts:
                same[0] = False
            tests = (same & (on_x == 0) & (on_y != 0), same & (on_y > 0), same & (on_y == 0) & (on_x != 0))
            begins = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
            for at, end in zip(begins, [*begins[1:], len(n)], strict=True):
                k = int(n[at])
                counts[k] = counts.get(k, 0) + np.array([t[at:end].sum() for t in tests], np.int64)
                if k not in firsts:
                    firsts[k] = [c.take(pa.array([at])) for c in now[1:]]
                lasts[k] = [c.take(pa.array([end - 1])) for c in now[1:]]
        if counts:
            each = list(counts)
            borders = [pa.concat_arrays([of[k][i] for k in each]) for of in (firsts, lasts) for i in range(x + y)]
            sums = [pa.array([int(counts[k][i]) for k in each], pa.int64()) for i in range(3)]
            names = ["part", "n", "splits", "swaps", "back_splits", *(f"{of}{i}" for of in ("f", "l") for i in range(x + y))]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(each), pa.int32()), pa.array(each, pa.int32()), *sums, *borders], names)

    return run
