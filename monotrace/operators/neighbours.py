"""Splits and swaps of many pairs of column lists, counted together.

Each row gives one (x, y) a pair of lists, pairs of the same types meet in one shuffle, and what is left of them after
partial deduplication is put in order by ranges. A range is a task, which compares neighbours as it reads; ranges of a pair
meet by one row each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import neighbours_counted, plain_key

COUNTS = ("splits", "swaps", "back_splits")
Lists = tuple[Sequence[str], Sequence[str]]


def neighbour_counts(df: DataFrame, lists: Sequence[Lists]) -> DataFrame:
    """n (place in `lists`), splits, swaps, back_splits over neighbours of the distinct (x, y) in order of x, then y.

    A split has equal x and different y, a swap a y below the one before, a back split equal y and different x;
    the last says that y does not order x where there are no swaps. Pairs of an empty table have no row.
    Pairs whose columns have the same types share a pass, so that keys are plain columns.
    """
    names = list(dict.fromkeys(c for x, y in lists for c in (*x, *y)))
    fields = df.select(*(plain_key(df, c).alias(f"k{i}") for i, c in enumerate(names))).schema.fields
    kinds = {c: f.dataType.simpleString() for c, f in zip(names, fields, strict=True)}
    alike: dict[tuple, list[int]] = defaultdict(list)
    for n, sides in enumerate(lists):
        alike[tuple(tuple(kinds[c] for c in side) for side in sides)].append(n)
    return reduce(DataFrame.unionByName, (_counts(df, [(n, *lists[n]) for n in same]) for same in alike.values()))


def _counts(df: DataFrame, numbered: Sequence[tuple[int, Sequence[str], Sequence[str]]]) -> DataFrame:
    """neighbour_counts of lists whose columns have the same types."""

    xs, ys = ([f"{side}{i}" for i in range(len(lists))] for side, lists in zip("xy", numbered[0][1:], strict=True))
    each = [F.struct(F.lit(n).alias("n"), *(plain_key(df, c).alias(name) for c, name in zip((*x, *y), (*xs, *ys), strict=True))) for n, x, y in numbered]
    pairs = df.select(F.inline(F.array(*each))).distinct()
    order = ["n", *xs, *ys]
    ranged = pairs.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = [pairs.schema[c] for c in (*xs, *ys)]
    borders = [T.StructField(f"{of}{i}", f.dataType) for of in ("f", "l") for i, f in enumerate(fields)]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in COUNTS), *borders])
    inner = ranged.mapInArrow(neighbours_counted(len(xs), len(ys)), schema)
    # a row a range and pair of lists from here on
    side = lambda of, at: F.struct(*(F.col(f"{of}{i}").alias(f"c{i - at.start}") for i in at))
    at_x, at_y = range(len(xs)), range(len(xs), len(fields))
    before = F.lag(F.struct(side("l", at_x).alias("x"), side("l", at_y).alias("y"))).over(Window.partitionBy("n").orderBy("part"))
    met = inner.select("n", *COUNTS, side("f", at_x).alias("x"), side("f", at_y).alias("y"), before.alias("before"))
    x, y, px, py = map(F.col, ("x", "y", "before.x", "before.y"))
    tests = {"splits": (px == x) & (py != y), "swaps": py > y, "back_splits": (py == y) & (px != x)}
    return met.groupBy("n").agg(*(F.sum(F.col(c) + F.coalesce(tests[c], F.lit(False)).cast("long")).alias(c) for c in COUNTS))
