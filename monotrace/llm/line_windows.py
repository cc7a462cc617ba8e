"""Line dedup over overlapping three-line windows.

Every run of three consecutive lines of a document is a window. Windows are compared over the whole
table by a 128-bit hash of their lines; the first one, by doc_id and then position, stays, and the
lines that later ones cover are removed. Overlapping windows merge, so a repeated passage of any
length from three lines goes as a whole, and what stands around it stays.

A document is known by its doc_id and a hash of its text, so rows that share a doc_id but not a text are
documents of their own. Work is in proportion to a document's lines: arrays of lines are cut by runs of
covered numbers, never searched line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, runs_of

SIZE = 3
KEY = ("doc_id", "text_hash")


def _keyed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))


def windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text_hash, at (0-based line), h1, h2: a row for each run of `size` lines; shorter documents have none."""
    lines = _keyed(docs).select(*KEY, F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= size)
    hashes = F.expr(f"transform(sequence(0, size(lines) - {size}), i -> named_struct('at', i, 'h1', xxhash64(slice(lines, i + 1, {size})), 'h2', xxhash64('second', slice(lines, i + 1, {size}))))")
    return lines.select(*KEY, F.explode(hashes).alias("w")).select(*KEY, "w.at", "w.h1", "w.h2")


def covered_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text_hash, covered: the line numbers that later occurrences cover, ascending; only documents that have some.

    A window that overlaps its own first occurrence in the same document covers what lies beyond that.
    Partial counts meet a hash once a task, and the join with the repeated windows is one that Spark
    can split where a hash is hot.
    """
    every = windows(docs, size)
    repeated = every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "at")).alias("first")).where("n > 1").drop("n")
    later = every.join(repeated, ["h1", "h2"]).where(~(F.struct(*KEY, "at").eqNullSafe(F.col("first"))))
    same = F.struct(*KEY).eqNullSafe(F.struct("first.doc_id", "first.text_hash"))
    begin = F.when(same, F.greatest("at", F.col("first.at") + size)).otherwise(F.col("at"))
    runs = later.select(*KEY, begin.alias("begin"), (F.col("at") + size).alias("end")).where("begin < end")
    by_doc = runs.groupBy(*KEY).agg(F.collect_set(F.struct("begin", "end")).alias("runs"))
    return by_doc.select(*KEY, F.expr("array_sort(array_distinct(flatten(transform(runs, r -> sequence(r.begin, r.end - 1)))))").alias("covered"))


def _with_kept(joined: DataFrame, text: Column, covered: str, out: str) -> DataFrame:
    """`joined` with the text without its covered lines in a column `out`. Arrays are columns of their own on the way, so that none is made anew for each line."""
    lines, begin, end = (fresh(joined, n) for n in ("lines_", "begin_", "end_"))
    first, last = runs_of(covered)
    cut = joined.withColumn(lines, F.when(F.col(covered).isNotNull(), F.split(text, "\n", -1))).withColumn(begin, first).withColumn(end, last)
    after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(end), i - 1) + 1)
    until = lambda i: F.when(i == F.size(begin), F.size(lines)).otherwise(F.get(F.col(begin), i))
    pieces = F.transform(F.sequence(F.lit(0), F.size(begin)), lambda i: F.slice(F.col(lines), after(i) + 1, until(i) - after(i)))
    return cut.withColumn(out, F.when(F.col(covered).isNull(), text).otherwise(F.array_join(F.flatten(pieces), "\n"))).drop(lines, begin, end)


def remove_repeated_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text without the lines that repeat an earlier window, n_lines, removed (their 0-based numbers, ascending).

    One row for each row of `docs`; a null text is the empty text, which is one empty line. Documents
    of fewer than `size` lines stay as they are. A document all of whose lines go has the empty text.
    Rows with equal doc_id and text are one document and are cut alike; rows that share a doc_id alone
    follow each other by a hash of their texts. Rows with a null doc_id are left alone. Other columns
    are not read.
    """
    covered = covered_lines(docs.where(F.col("doc_id").isNotNull()), size)
    joined = _keyed(docs).join(covered, list(KEY), "left")
    none = F.array().cast("array<int>")
    return _with_kept(joined, F.col("text"), "covered", "kept").select(
        "doc_id",
        F.col("kept").alias("text"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("covered", none).alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of `docs`, with all their columns, each text without its repeated lines; rows without any are as they were."""
    own_id, own_hash, gone = (fresh(docs, n) for n in ("covered_id", "covered_hash", "covered"))
    text = F.col("text").cast("string")
    covered = covered_lines(docs.where(F.col("doc_id").isNotNull()), size).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("covered").alias(gone))
    joined = docs.join(covered, (F.col("doc_id").cast("long") == F.col(own_id)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(own_hash)), "left")
    return _with_kept(joined, text, gone, "text").drop(own_id, own_hash, gone).select(*docs.columns)


#: The same in DuckDB, over whole lines instead of their hashes.
ORACLE = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(len(ls) - 2)) AS pos, ls FROM l WHERE len(ls) >= 3),
k AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS key FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS rn,
        first_value(doc_id) OVER (PARTITION BY key ORDER BY doc_id, pos) AS fd,
        first_value(pos) OVER (PARTITION BY key ORDER BY doc_id, pos) AS fa FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN fd = doc_id THEN greatest(pos, fa + 3) ELSE pos END, pos + 3)) AS line FROM f WHERE rn > 1),
g AS (SELECT doc_id, list(line ORDER BY line) AS gone FROM c GROUP BY doc_id),
j AS (SELECT l.doc_id, l.ls, coalesce(g.gone, []) AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed,
  array_to_string(gone, ',') AS removed,
  sha256(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), chr(10))) AS kept_sha256
FROM j
"""
