"""Candidates of the search: pairs (x, y) of lists of column numbers without a common member."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "x array<int>, y array<int>"


def first_candidates(spark: SparkSession, columns: Sequence[int]) -> DataFrame:
    """All pairs of single columns, the smaller number on the left."""
    ids = spark.createDataFrame([(int(c),) for c in sorted(set(columns))], "c int")
    return ids.alias("a").join(ids.alias("b"), F.expr("a.c < b.c")).select(F.array("a.c").alias("x"), F.array("b.c").alias("y"))


def expanded(candidates: DataFrame, columns: Sequence[int], left: bool) -> DataFrame:
    """Each candidate with every column that it lacks at the end of one side."""
    reduced = F.array(*(F.lit(int(c)) for c in columns)).cast("array<int>")
    new = F.explode(F.array_except(reduced, F.concat("x", "y")))
    added = candidates.select("x", "y", new.alias("c"))
    if left:
        return added.select(F.concat("x", F.array("c")).alias("x"), "y")
    return added.select("x", F.concat("y", F.array("c")).alias("y"))


def mirrored(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.col("y").alias("x"), F.col("x").alias("y"))


def named(candidates: DataFrame, names: Sequence[str]) -> DataFrame:
    """lhs, rhs: the lists with column names for numbers; other columns stay."""
    known = F.array(*map(F.lit, names))
    rest = [c for c in candidates.columns if c not in ("x", "y")]
    as_names = lambda c: F.transform(c, lambda i: F.element_at(known, i + 1))
    return candidates.select(*rest, as_names("x").alias("lhs"), as_names("y").alias("rhs"))
