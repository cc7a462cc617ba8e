"""Rows of CSV files whose quoted values hold line feeds, read in many tasks.

A line alone does not tell whether it starts a row or goes on in a quoted value; the state before it does, and each line maps a state before to
a state after. One pass composes these maps over each split of the files, which leaves a row a split; put one after the other
they tell how each split begins. A second pass then cuts every split into rows from its true start. What a row that
crosses splits leaves in each of them, two parts a split at most, is put together at the end.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Rows within a split, the end of one begun before it, the beginning of one that goes on after it, and a split within a row.
WHOLE, END, BEGIN, WITHIN = range(4)


def after_line(line: str, inside: bool, delimiter: str, quote: str) -> bool:
    """Whether a quoted value goes on after this line. Only a quote that opens a field counts, two in a value are one of its characters, and what follows a value's end up to the delimiter is no value of its own."""
    at = 0
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            inside, at = False, line.find(delimiter, at + 1) + 1
            if not at:
                return False
        rest = line.find(quote, at)
        if rest < 0:
            return False
        # fields up to that quote: it opens one if nothing but spaces stands between it and the delimiter before it
        if not line[max(at, line.rfind(delimiter, at, rest) + 1) : rest].strip(" \t"):
            inside, at = True, rest + 1
            continue
        at = line.find(delimiter, rest) + 1
        if not at:
            return False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block: the lines, with the file and the place in it where their split begins. A split's lines come in order, one split after another."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block")), strict=True)


def open_splits(lines: DataFrame, delimiter: str, quote: str) -> tuple[bool, DataFrame]:
    """Whether a line ends within quotes, and file, block of the splits that begin within quotes."""

    def run(batches):
        split, out = None, []
        after, opened = [False, True], [False, False]
        for value, *here in _rows(batches):
            if here != split:
                if split:
                    out.append((*split, *after, *opened))
                split, after, opened = here, [False, True], [False, False]
            if quote in value:
                after = [after_line(value, state, delimiter, quote) for state in after]
            opened = [a or b for a, b in zip(opened, after, strict=True)]
        if split:
            out.append((*split, *after, *opened))
        yield pa.RecordBatch.from_pydict({c: [r[k] for r in out] for k, c in enumerate(_SPLIT.names)}, schema=_SPLIT)

    def walk(table: pa.Table) -> pa.Table:
        """The splits of one file in order: how each begins, and whether a line in it ends within quotes."""
        state, rows = False, []
        for r in table.sort_by("block").to_pylist():
            rows.append({"file": r["file"], "block": r["block"], "inside": state, "opened": r["opened1" if state else "opened0"]})
            state = r["after1" if state else "after0"]
        return pa.Table.from_pylist(rows, schema=_BEGUN)

    splits = lines.mapInArrow(run, "file string, block long, after0 boolean, after1 boolean, opened0 boolean, opened1 boolean")
    begun = splits.groupBy("file").applyInArrow(walk, "file string, block long, inside boolean, opened boolean").where("inside OR opened")
    some = stored(begun.select("file", "block", "inside"), "splits")
    return not some.isEmpty(), some.where("inside").drop("inside")


_SPLIT = pa.schema([("file", pa.string()), ("block", pa.int64()), *((c, pa.bool_()) for c in ("after0", "after1", "opened0", "opened1"))])
_BEGUN = pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("opened", pa.bool_())])


def records(lines: DataFrame, inside: DataFrame, delimiter: str, quote: str) -> DataFrame:
    """value, first: the rows of the files as texts, and whether each is its file's first one. `inside` are the splits that begin within quotes."""
    begun = lines.join(F.broadcast(inside.withColumn("inside", F.lit(True))), ["file", "block"], "left").select("value", "file", "block", F.coalesce("inside", F.lit(False)).alias("inside"))

    def run(batches):
        split, out = None, []
        held: list[str] = []
        state = began_inside = first = False

        def end(kind):
            nonlocal held, first
            out.append(("\n".join(held), *split, kind, first and kind in (WHOLE, BEGIN)))
            held, first = [], False

        def flushed():
            nonlocal out
            got, out = pa.RecordBatch.from_pydict({c: [r[k] for r in out] for k, c in enumerate(_PART.names)}, schema=_PART), []
            return got

        for batch in batches:
            for value, file, block, inside_here in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block", "inside")), strict=True):
                if (file, block) != split:
                    if held:
                        end(WITHIN if began_inside else BEGIN)
                    split, state, began_inside, first = (file, block), inside_here, inside_here, block == 0
                held.append(value)
                if quote in value:
                    state = after_line(value, state, delimiter, quote)
                if not state:
                    end(END if began_inside else WHOLE)
                    began_inside = False
            if out:
                yield flushed()
        if held:
            end(WITHIN if began_inside else BEGIN)
        if out:
            yield flushed()

    # kept in the shared folder: types, names and every later scan of the table read rows that are cut already
    parts = stored(begun.mapInArrow(run, "value string, file string, block long, kind int, first boolean"), "csv-rows")
    # two parts a split at most: the end of a row comes before the beginning of the next
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == BEGIN)
    crossing = parts.where(F.col("kind") != WHOLE).withColumn("row", F.sum(F.when(F.col("kind") == BEGIN, 1).otherwise(0)).over(order))
    joined = crossing.groupBy("file", "row").agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("parts"), F.max("first").alias("first"))
    return parts.where(F.col("kind") == WHOLE).select("value", "first").unionByName(joined.select(F.array_join("parts.value", "\n").alias("value"), "first"))


_PART = pa.schema([("value", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_())])
