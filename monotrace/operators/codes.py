"""Ranks of columns made on the cluster, and verdicts from them, for tables of any size.

Each column's distinct values are put in order by ranges and numbered, unless they are many whole numbers, which
are their own ranks; the numbers are joined back and the table is stored once as whole numbers. A list of columns is then one number, the mixed-radix number of its
columns' ranks, and all candidates of a level are checked in one job without sorting rows: rows meet by the
number of one side, partly aggregated to the least and greatest number of the other sides; what is put in order
by ranges is one row a value of that side, once for all candidates that share it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import sort_key
from ..storage import stored

Pair = tuple[Sequence[int], Sequence[int]]
VERDICT_SCHEMA = "x array<int>, y array<int>, ocd boolean, od_xy boolean, od_yx boolean"
#: Values of dictionaries that are given to every task, in number and in bytes of all of them together; larger ones are joined by shuffle.
GIVEN_VALUES, GIVEN_BYTES = 1_000_000, 64 << 20
#: Values of a column of whole numbers or times that get dense ranks; of more, the distance from the least one is the rank.
DENSE_VALUES = 50_000
#: A number of a list stays below this; a list with more values takes several numbers.
WIDEST = 1 << 62
#: Other sides that one group of rows carries, and groups that one scan of the ranks makes: what the compiled code of a row can hold.
SLOTS, AT_ONCE = 8, 16


def numbered(distinct: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, code: each value's place (from 0, nulls first) among those with the same `by`.

    Ranges are tasks: each numbers its own values, and one row a range and `by` tells how many came before. They are
    stored, so that both see the same ranges.
    """
    # ascending within a range, and the range's number in the upper bits
    at = distinct.repartitionByRange(by, value).sortWithinPartitions(by, F.col(value).asc_nulls_first()).withColumn("at", F.monotonically_increasing_id())
    ranged = stored(at.withColumn("part", F.shiftright("at", 33)), "ranges")
    sizes = ranged.groupBy("part", by).agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = sizes.select("part", by, (F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n") - F.col("least")).alias("shift"))
    # a row a range and column, however many values there are
    return ranged.join(F.broadcast(before), ["part", by]).select(by, value, (F.col("at") + F.col("shift")).alias("code"))


def whole_number(kind: T.DataType, key: Column) -> Column | None:
    """A sort key as a whole number in the same order: whole numbers, dates by days, times by seconds; None for other types."""
    if isinstance(kind, T.IntegralType):
        return key.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(key)
    if isinstance(kind, T.TimestampNTZType):  # by its fields: a cast would take the session's zone, whose clock may go back
        return F.unix_date(key.cast("date")).cast("long") * 86_400 + F.hour(key) * 3_600 + F.minute(key) * 60 + F.floor(F.second(key))
    return None


class Codes:
    """A table as ranks: `table` has a column r0, r1, ... for each of `columns`, `counts` how many ranks each may have, `values` how many it has (null is one).

    Ranks are dense but for `spread` columns: whole numbers and times of more than DENSE_VALUES values are numbered by their distance from the
    least one, so that neither their values nor the table are shuffled for them.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.spark, self.columns = df.sparkSession, list(columns)
        keys = df.select(*(sort_key(df, c).alias(f"v{i}") for i, c in enumerate(self.columns)))
        plain = {i: n for i, f in enumerate(keys.schema.fields) if (n := whole_number(f.dataType, F.col(f"v{i}"))) is not None}
        ends = keys.agg(*(a for i, n in plain.items() for a in (F.approx_count_distinct(n).alias(f"n{i}"), F.min(n).alias(f"least{i}"), F.max(n).alias(f"most{i}"), F.count_if(n.isNull()).alias(f"nulls{i}")))).first() if plain else {}
        #: Column -> code: distance from the least value, from 1 where there are nulls.
        spread, self.counts, self.values = {}, [0] * len(self.columns), [0] * len(self.columns)
        for i, n in plain.items():
            if ends[f"n{i}"] > DENSE_VALUES and (span := ends[f"most{i}"] - ends[f"least{i}"] + 2) < WIDEST:
                spread[i] = F.coalesce(n - F.lit(ends[f"least{i}"]).cast("long") + int(ends[f"nulls{i}"] > 0), F.lit(0).cast("long"))
                self.counts[i], self.values[i] = span, ends[f"n{i}"]
        self.spread = set(spread)
        kinds: dict[str, list[int]] = defaultdict(list)
        for i, f in enumerate(keys.schema.fields):
            if i not in spread:
                kinds[f.dataType.simpleString()].append(i)
        dictionaries, bytes_of = {}, [0] * len(self.columns)
        for same in kinds.values():
            # columns of one type meet in one pass: a row apiece, most of which are merged before the shuffle
            each = F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in same))
            told = stored(numbered(keys.select(F.inline(each)).distinct(), "c", "v"), "dictionary")
            size = F.coalesce(F.octet_length("v"), F.lit(0)) if isinstance(keys.schema[same[0]].dataType, T.StringType) else F.lit(0)
            for r in told.groupBy("c").agg(F.count("*").alias("n"), F.sum(size + 16).alias("bytes")).collect():  # a row a column
                self.counts[r["c"]], self.values[r["c"]], bytes_of[r["c"]] = r["n"], r["n"], r["bytes"]
            dictionaries |= dict.fromkeys(same, told)
        kind = lambda i: "int" if self.counts[i] < 1 << 31 else "long"
        self.table, values, size = keys.select(*((spread[i].cast(kind(i)).alias(f"r{i}") if i in spread else F.col(f"v{i}")) for i in range(len(self.columns)))), 0, 0
        for i in sorted(set(range(len(self.columns))) - self.spread, key=lambda i: self.counts[i]):
            codes = dictionaries[i].where(F.col("c") == i).select(F.col("v").alias("w"), F.col("code").cast(kind(i)).alias(f"r{i}"))
            values, size = values + self.counts[i], size + bytes_of[i]
            given = F.broadcast(codes) if values <= GIVEN_VALUES and size <= GIVEN_BYTES else codes
            self.table = self.table.join(given, F.col(f"v{i}").eqNullSafe(F.col("w"))).drop(f"v{i}", "w")
        self.table = stored(self.table.select(*(f"r{i}" for i in range(len(self.columns)))), "codes")
        #: (candidates, lists whose values were put in order) of each call of `verdicts`.
        self.sorts: list[tuple[int, int]] = []

    def close_rows(self, most: int) -> np.ndarray:
        """Ranks of at most `most` rows, one line a column: for each column some that stand close together in its order.

        What rows far apart do not show, they may: a violation among them is one of the table. Columns of few values have no such rows.
        """
        each = max(1, most // max(1, len(self.columns)))
        rows, parts = self.table.count(), []
        for i, n in enumerate(self.counts):
            width = each * n // max(1, rows)
            if width >= 2:
                # another stretch for each column, so that they are not all at the begin
                begin = int((n - width) * ((i + 1) * 0.618034 % 1))
                parts.append(self.table.where(F.col(f"r{i}").between(begin, begin + width - 1)).limit(each))
        if not parts:
            return np.zeros((len(self.columns), 0), np.int32)
        found = reduce(DataFrame.unionByName, parts).toArrow()
        return np.array([np.unique(found.column(f"r{i}").to_numpy(), return_inverse=True)[1] for i in range(len(self.columns))], np.int32)

    def equivalent(self, groups: Sequence[Sequence[int]]) -> list[list[int]]:
        """Of each group of columns, the classes whose ranks are the same in every row; classes of two or more.

        One aggregate gives each column a digest of (row, rank); columns meet only where it is the same, and each is then compared
        with its class's first. So the checks are as many as columns. Columns whose ranks are not dense are compared by their order.
        """
        classes, apart = [], [list(g) for g in groups if len(g) > 1 and self.spread.intersection(g)]
        while apart:
            told = self.verdicts([((g[0],), (i,)) for g in apart for i in g[1:]]).where("od_xy AND od_yx").select(F.get("x", F.lit(0)), F.get("y", F.lit(0))).collect()
            same = {tuple(r) for r in told}
            classes += [kept for g in apart if len(kept := [g[0], *(i for i in g[1:] if (g[0], i) in same)]) > 1]
            apart = [odd for g in apart if len(odd := [i for i in g[1:] if (g[0], i) not in same]) > 1]
        left = [list(g) for g in groups if len(g) > 1 and not self.spread.intersection(g)]
        while left:
            members = [i for g in left for i in g]
            rows = self.table.withColumn("row", F.monotonically_increasing_id())
            digests = dict(zip(members, rows.agg(*(F.bit_xor(F.xxhash64("row", F.col(f"r{i}").cast("long"))) for i in members)).first(), strict=True))
            alike: dict[tuple, list[int]] = defaultdict(list)
            for n, g in enumerate(left):
                for i in g:
                    alike[n, self.counts[i], digests[i]].append(i)
            pairs = [(same[0], i) for same in alike.values() for i in same[1:]]
            left = []
            if pairs:
                wrong = self.table.agg(*(F.count_if(F.col(f"r{a}") != F.col(f"r{b}")) for a, b in pairs)).first()
                apart = {b for (_, b), n in zip(pairs, wrong, strict=True) if n}
                classes += [kept for same in alike.values() if len(kept := [i for i in same if i not in apart]) > 1]
                left = [odd for same in alike.values() if len(odd := [i for i in same if i in apart]) > 1]
        return classes

    def _numbers(self, columns: Sequence[int]) -> list[str]:
        """A list's columns as mixed-radix numbers, each below WIDEST; almost always one. As SQL, for there may be hundreds of lists."""
        numbers, size = [], WIDEST
        for i in columns:
            count, code = max(1, self.counts[i]), f"CAST(r{i} AS BIGINT)"
            if size * count >= WIDEST:
                numbers.append(code)
                size = count
            else:
                numbers[-1] = f"({numbers[-1]}) * {count}L + {code}"
                size *= count
        return numbers

    def verdicts(self, pairs: Sequence[Pair]) -> DataFrame:
        """x, y, ocd, od_xy, od_yx of all these pairs of lists, in one job. All of them hold in a table without rows.

        Rows are grouped by the side with fewer values. With the groups in order: if a group's greatest other side lies above the next
        one's least, there is a swap; if none does, equal ones mean that the other side does not order this one, and
        a group with several other sides that this side does not order the other.
        """
        bound = lambda side: prod(max(1, self.values[i]) for i in side)
        sides: dict[tuple[int, ...], list[tuple[Pair, bool]]] = defaultdict(list)
        for x, y in pairs:
            flipped = bound(y) < bound(x)
            sides[tuple(y if flipped else x)].append(((x, y), flipped))
        self.sorts.append((len(pairs), len(sides)))
        parts = [(by, own[at : at + SLOTS]) for by, own in sides.items() for at in range(0, len(own), SLOTS)]
        slots = range(max(len(own) for _, own in parts))
        numbers = {side: self._numbers(side) for x, y in pairs for side in (tuple(x), tuple(y))}
        width, place_of = max(map(len, numbers.values())), {side: j for j, side in enumerate(numbers)}
        kind = "BIGINT" if width == 1 else "STRUCT<" + ", ".join(f"n{k}: BIGINT" for k in range(width)) + ">"
        keys = [f"k{k}" for k in range(width)]
        key = ", ".join(keys)

        def number(side: Sequence[int]) -> list[str]:
            own = numbers[tuple(side)]
            return [f"n{place_of[tuple(side)]}_{k}" if k < len(own) else "0L" for k in range(width)]

        def other(own: list, s: int) -> str:
            """The s-th other side, null where there are fewer."""
            if s >= len(own):
                return f"CAST(NULL AS {kind})"
            (x, y), flipped = own[s]
            got = number(x if flipped else y)
            return got[0] if width == 1 else "named_struct(" + ", ".join(f"'n{k}', {n}" for k, n in enumerate(got)) + ")"

        def rows_of(some: list) -> DataFrame:
            """A row for each row of the table and each of these groups."""
            used = dict.fromkeys(tuple(side) for _, (by, own) in some for side in (by, *(z for pair, _ in own for z in pair)))
            known = self.table.selectExpr(*(f"{n} AS n{place_of[side]}_{k}" for side in used for k, n in enumerate(numbers[side])))
            fields = lambda g, by, own: [("g", str(g)), *zip(keys, number(by), strict=True), *((f"y{s}", other(own, s)) for s in slots)]
            each = ", ".join("named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields(g, by, own)) + ")" for g, (by, own) in some)
            return known.selectExpr(f"inline(array({each}))")

        listed = list(enumerate(parts))
        exploded = reduce(DataFrame.unionByName, (rows_of(listed[at : at + AT_ONCE]) for at in range(0, len(listed), AT_ONCE)))
        groups = exploded.groupBy("g", *keys).agg(*(F.expr(f"{f}(y{s}) AS {name}{s}") for s in slots for name, f in (("lo", "min"), ("hi", "max"))))
        ranged = groups.repartitionByRange("g", *keys).withColumn("part", F.spark_partition_id())
        highs, lows = (f"struct({', '.join(f'{name}{s}' for s in slots)})" for name in ("hi", "lo"))
        near = ranged.selectExpr("*", f"lag({highs}) OVER (PARTITION BY part, g ORDER BY {key}) AS before")

        def tests(lo: str) -> list[Column]:
            return [F.expr(f"coalesce(max(before.hi{s} {sign} {lo}{s}), false) AS {what}{s}") for s in slots for what, sign in (("swap", ">"), ("meet", ">="))]

        splits = [F.expr(f"coalesce(max(lo{s} < hi{s}), false) AS split{s}") for s in slots]
        inner = near.groupBy("g", "part").agg(*tests("lo"), *splits, F.expr(f"min_by({lows}, struct({key})) AS first"), F.expr(f"max_by({highs}, struct({key})) AS last"))
        # a row a range and group of rows from here on
        borders = inner.selectExpr("*", "lag(last) OVER (PARTITION BY g ORDER BY part) AS before")
        across = borders.groupBy("g").agg(*tests("first.lo"), *(F.expr(f"max({what}{s}) AS own_{what}{s}") for s in slots for what in ("swap", "meet", "split")))
        flags = ", ".join(f"named_struct('s', {s}, 'swap', own_swap{s} OR swap{s}, 'meet', own_meet{s} OR meet{s}, 'split', own_split{s})" for s in slots)
        told = across.selectExpr("g", f"inline(array({flags}))")
        place = self.spark.createDataFrame([(g, s, list(x), list(y), flipped) for g, (_, own) in enumerate(parts) for s, ((x, y), flipped) in enumerate(own)], "g int, s int, x array<int>, y array<int>, flipped boolean")
        no = {what: ~F.coalesce(what, F.lit(False)) for what in ("swap", "meet", "split")}
        return place.join(told, ["g", "s"], "left").select(
            "x",
            "y",
            no["swap"].alias("ocd"),
            (no["swap"] & F.when(F.col("flipped"), no["meet"]).otherwise(no["split"])).alias("od_xy"),
            (no["swap"] & F.when(F.col("flipped"), no["split"]).otherwise(no["meet"])).alias("od_yx"),
        )
