"""Checks of columns and lists of columns: constants, order equivalence, order dependency, order compatibility.

X orders Y (an order dependency) if rows in ascending order of the list X are in ascending order of the
list Y as well. Two rows that agree on X and differ on Y are a split; rows that rise on X and fall on Y a
swap. X and Y are order compatible if there is no swap.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.keys import checked_columns, keyed, supported_columns
from .neighbours import neighbour_counts
from .ranges import first_violations, plain_key, signs
from .ranks import refuted

#: Bytes of a range's two border values that the driver takes at most; longer ones are compared on the cluster.
LONGEST_BORDER = 4096


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n_rows, n_distinct (null counts as a value; full precision), is_constant.

    The table is read once for each kind of value that it has, and of it the columns of that kind: whole numbers (with dates, times and truth
    values), broken ones, texts, each type of decimals. Values are counted with their columns' numbers where they are read and meet by column
    and value, so that a column whose values repeat shuffles few of them. A column is constant if it has exactly one value, null or not, or the
    null type. A table without rows has no constant columns but those of the null type.
    """
    names = supported_columns(df) if columns is None else checked_columns(df, columns)

    def value(name: str) -> tuple[str, Column]:
        kind, column = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.NullType):
            return "bigint", F.lit(None).cast("long")
        if isinstance(kind, T.TimestampType):
            return "bigint", F.unix_micros(column)
        if isinstance(kind, T.DateType):
            return "bigint", F.unix_date(column).cast("long")
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            return "bigint", column.cast("long")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return "double", column.cast("double")
        return ("string" if isinstance(kind, T.StringType) else kind.simpleString()), column

    values = [value(n) for n in names]
    kinds = list(dict.fromkeys(k for k, _ in values))
    each = lambda kind: F.array(*(F.struct(F.lit(i).alias("c"), v.alias("v")) for i, (k, v) in enumerate(values) if k == kind))
    met = (df.select(F.inline(each(kind))).groupBy("c", "v").agg(F.count("*").alias("n")).groupBy("c").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct")) for kind in kinds)
    counts = reduce(DataFrame.unionByName, met)
    # a row a column from here on
    told = counts.agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("n_rows", "n_distinct").alias("n")))).alias("of"))
    count = lambda i, what: F.coalesce(F.col("of")[F.lit(i)][what], F.lit(0).cast("long"))
    void = [isinstance(df.schema[n].dataType, T.NullType) for n in names]
    lines = [F.struct(F.lit(n).alias("column"), count(i, "n_rows").alias("n_rows"), count(i, "n_distinct").alias("n_distinct"), (F.lit(void[i]) | (count(i, "n_distinct") == 1)).alias("is_constant")) for i, n in enumerate(names)]
    return told.select(F.inline(F.array(*lines)))


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column of each constant column.

    Least and greatest value decide, so nothing is shuffled but one row a task.
    """
    names = supported_columns(df) if columns is None else checked_columns(df, columns)
    same = [((F.count("*") > 0) & F.min(f"`{n}`").eqNullSafe(F.max(f"`{n}`")) & ((F.count(f"`{n}`") == F.count("*")) | (F.count(f"`{n}`") == 0)) | F.lit(df.schema[n].dataType.typeName() == "void")).alias(f"c{i}") for i, n in enumerate(names)]
    one = df.agg(*same)
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("constant")) for i, n in enumerate(names))))).where("constant").select("column")


def check_constant(df: DataFrame, column: str) -> bool:
    return constant_columns(df, [column]).count() == 1


def od_violations(df: DataFrame, x: Sequence[str], y: Sequence[str]) -> DataFrame:
    """One row (splits, swaps), counted over neighbours of the distinct (X, Y) in order of X, then Y."""
    counts = neighbour_counts(df, [(checked_columns(df, x), checked_columns(df, y))])
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("splits", "swaps")))


def _holds(df: DataFrame, x: list[str], y: list[str], splits_matter: bool, longest: int = LONGEST_BORDER) -> bool:
    """Groups of equal X in ranges of X; a range is a task, and ranges meet by one row each.

    The ranges are checked in waves that grow: a limit asks for as many rows as there may be ranges, of which each gives one, and
    one with a violation all. So ranges of later waves are never begun once one was found.
    """
    spark, xs, ys = df.sparkSession, [f"x{i}" for i in range(len(x))], [f"y{i}" for i in range(len(y))]
    sides = df.select(*(plain_key(df, n).alias(c) for n, c in zip((*x, *y), (*xs, *ys), strict=True)))
    if len(y) == 1:
        # numbers as they are: these need no sorting where rows meet
        least, most = F.when(F.max(F.col("y0").isNull()), F.lit(None)).otherwise(F.min("y0")), F.max("y0")
        groups = sides.groupBy(*xs).agg(least.alias("lo0"), most.alias("hi0"))
    else:
        groups = sides.groupBy(*xs).agg(F.min(F.struct(*ys)).alias("lo"), F.max(F.struct(*ys)).alias("hi"))
        groups = groups.select(*xs, *(F.col(f"{end}.y{i}").alias(f"{end}{i}") for end in ("lo", "hi") for i in range(len(y))))
    order, borders = [F.col(c).asc_nulls_first() for c in xs], [f"{end}{i}" for end in ("lo", "hi") for i in range(len(y))]
    ranged = groups.repartitionByRange(*order).sortWithinPartitions(*order).select(*borders)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("bad", T.BooleanType()), T.StructField("wide", T.BooleanType()), *ranged.schema.fields])
    ranges = max(int(spark.conf.get(f"spark.sql.{name}", "1")) for name in ("shuffle.partitions", "adaptive.coalescePartitions.initialPartitionNum"))
    told = ranged.mapInArrow(first_violations(len(y), splits_matter, ranges, longest), schema).limit(ranges).collect()
    if any(r["bad"] for r in told):
        return False
    if any(r["wide"] for r in told):
        # long texts: ranges meet on the cluster
        parts = ranged.mapInArrow(first_violations(len(y), splits_matter, 1, None), schema)
        end = lambda of: F.struct(*(F.col(f"{of}{i}").alias(f"c{i}") for i in range(len(y))))
        return parts.select(end("lo").alias("lo"), F.lag(end("hi")).over(Window.orderBy("part")).alias("before")).where("before > lo").limit(1).count() == 0
    told.sort(key=lambda r: r["part"])
    ends = {c: pa.array([r[c] for r in told], to_arrow_type(schema[c].dataType)) for c in borders}
    lasts, firsts = ([ends[f"{end}{i}"] for i in range(len(y))] for end in ("hi", "lo"))
    return len(told) < 2 or not (signs([c.slice(0, len(told) - 1) for c in lasts], [c.slice(1) for c in firsts]) > 0).any()


def check_od(df: DataFrame, x: Sequence[str], y: Sequence[str]) -> bool:
    """Whether X orders Y; true for tables of no or one row. A few rows may refute it; else, for any size: rows with equal X meet partly aggregated, and ranges of X are tasks, in waves that end at the first violation."""
    x, y = checked_columns(df, x), checked_columns(df, y)
    return not refuted(df, x, y, splits_matter=True) and _holds(df, x, y, splits_matter=True)


def check_ocd(df: DataFrame, x: Sequence[str], y: Sequence[str]) -> bool:
    """Whether X and Y are order compatible: XY orders YX."""
    x, y = checked_columns(df, x), checked_columns(df, y)
    both = list(dict.fromkeys([*x, *y]))
    # equal XY means equal YX, so there are no splits
    return not refuted(df, x, y, splits_matter=False) and _holds(df, both, list(dict.fromkeys([*y, *x])), splits_matter=False)


def check_equivalent(df: DataFrame, a: str, b: str) -> bool:
    """Whether two columns order each other; distinct counts that differ refute it at once."""
    a, b = checked_columns(df, [a])[0], checked_columns(df, [b])[0]
    if a == b:
        return True
    keys = keyed(df, [a, b])
    one, two = keys.agg(*((F.count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0))) for c in ("k0", "k1"))).first()
    return one == two and check_od(df, [a], [b]) and check_od(df, [b], [a])


def pair_verdicts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, ocd, od_ab, od_ba, equivalent for all pairs of columns, a before b. All of them hold in a table without rows."""
    from ..plans.verdicts import Checker
    from .candidates import first_candidates, named

    names = checked_columns(df, columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, ocd boolean, od_ab boolean, od_ba boolean, equivalent boolean")
    told = named(Checker(df, names).verdicts(first_candidates(df.sparkSession, range(len(names)))), names)
    return told.select(F.get("lhs", F.lit(0)).alias("a"), F.get("rhs", F.lit(0)).alias("b"), "ocd", F.col("od_xy").alias("od_ab"), F.col("od_yx").alias("od_ba"), (F.col("od_xy") & F.col("od_yx")).alias("equivalent"))


def order_compatible_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b of the pairs of single columns that are order compatible."""
    return pair_verdicts(df, columns).where("ocd").select("a", "b")
