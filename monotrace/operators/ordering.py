"""Lexicographic orders of a table, as row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import checked_columns, sort_key
from ..storage import stored


def sorted_with_indices(df: DataFrame, column: str, index: str) -> DataFrame:
    """The column's values in ascending order, nulls first, each with its row's index; ties in order of the index."""
    checked_columns(df, [column])
    return df.orderBy(sort_key(df, column).asc_nulls_first(), F.col(index).asc()).select(F.col(f"`{column}`"), index)


def sorted_with_positions(df: DataFrame, column: str, index: str) -> DataFrame:
    """position (from 0), value, index: the column in ascending order, nulls first, each value with its row's index; ties in order of the index. Indices may be null or repeat: a row of the table is a row here."""
    checked_columns(df, [column])
    return _numbered(df, [column], index, {"value": F.col(f"`{column}`")}).select("position", "value", "index")


def with_positions(files: DataFrame, name: str = "position") -> DataFrame:
    """A table as it was read from files, with each row's place in them, from 0: files in order of their names, rows as they stand there.

    So rows have an order and an identity without a key. A split is read from its begin to its end by one task; its rows are counted, and what lies
    before it is summed over a row a split, of which there are as many as tasks read the files.
    """
    at = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = at.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("least"))
    # a row a split
    before = splits.select("_file", "_block", (F.sum("n").over(Window.orderBy("_file", "_block")) - F.col("n") - F.col("least")).alias("shift"))
    return at.join(F.broadcast(before), ["_file", "_block"]).select(*(F.col(f"`{c}`") for c in files.columns), (F.col("_at") + F.col("shift")).alias(name))


def sorted_column(df: DataFrame, column: str) -> DataFrame:
    """The column alone, in ascending order, nulls first."""
    checked_columns(df, [column])
    return df.select(f"`{column}`").orderBy(F.col(f"`{column}`").asc_nulls_first())


def ordered_by_all(df: DataFrame, index: str) -> DataFrame:
    """ordered_indices by all columns but the index, from left to right."""
    return ordered_indices(df, [c for c in df.columns if c != index], index)


def ordered_indices(df: DataFrame, columns: Sequence[str], index: str) -> DataFrame:
    """position (from 0), index: the rows in lexicographic order of the columns; no columns give no rows.

    Positions are counted range by range: a global sort makes the ranges, each numbers its rows, and one row a
    range tells how many came before. The ranges are stored, so that both counts see the same ones.
    """
    return _numbered(df, columns, index, {}).select("position", "index")


def _numbered(df: DataFrame, columns: Sequence[str], index: str, more: dict[str, Column]) -> DataFrame:
    """position, index and more columns of each row, in order of the columns, then the index."""
    names = checked_columns(df, columns, allow_empty=True)
    rows = df.select(*(sort_key(df, c).alias(f"o{i}") for i, c in enumerate(names)), F.col(f"`{index}`").alias("index"), *(c.alias(n) for n, c in more.items()))
    if not names:
        return rows.where(F.lit(False)).select(F.lit(0).cast("long").alias("position"), "index", *more)
    order = [*(F.col(f"o{i}").asc_nulls_first() for i in range(len(names))), F.col("index").asc()]
    ranged = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    numbered = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # a row a range: bounded by the number of shuffle partitions
    return numbered.join(F.broadcast(before), "part").select((F.col("before") + F.col("at") - 1).cast("long").alias("position"), "index", *more)


def ordered_indices_by(df: DataFrame, positions: Sequence[int], index: str) -> DataFrame:
    """ordered_indices by column numbers, counted from 0; a number that is out of range is a ValueError."""
    names = [c for c in df.columns if c != index]
    if any(not 0 <= p < len(names) for p in positions):
        raise ValueError(f"columns are numbered 0..{len(names) - 1}")
    return ordered_indices(df, [names[p] for p in positions], index)
