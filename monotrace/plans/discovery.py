"""Discovery of all order dependencies of a table, level by level.

Constant columns and all but one of each class of equivalent columns are put aside; candidates are pairs of
lists of the rest. An incompatible candidate ends its branch. For a compatible one, a side that orders
the other is reported and not made longer; a side that does not gets every unused column at its end.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import checked_columns, supported_columns
from ..operators.candidates import SCHEMA, expanded, first_candidates, named
from ..operators.checks import constant_columns
from ..operators.codes import VERDICT_SCHEMA
from ..storage import new_path, read_json, write_json
from .verdicts import MOST_RANKS, Checker

RESULT_SCHEMA = "kind string, lhs array<string>, rhs array<string>"


@dataclass
class Discovery:
    """What was found; `results` has a row (kind OD or OCD, lhs, rhs) a dependency."""

    constants: list[str]
    #: Representative (the class's first column) -> all members, for classes of one member too.
    classes: dict[str, list[str]]
    reduced: list[str]
    results: DataFrame
    #: (level, candidates, compatible ones)
    levels: list[tuple[int, int, int]] = field(default_factory=list)
    timings: dict[str, float] = field(default_factory=dict)
    #: Results by kind, counted while the levels were written.
    counts: dict[str, int] = field(default_factory=dict)

    def equivalences(self, spark: SparkSession) -> DataFrame:
        """representative, members: classes of two members or more."""
        rows = [(r, m) for r, m in self.classes.items() if len(m) > 1]
        return spark.createDataFrame(rows, "representative string, members array<string>")


def _search(checker: Checker, ids: Sequence[int], comparability: bool, max_level: int | None, levels: list, counts: dict[str, int], state: str) -> DataFrame:
    """The search over the checker's columns with these numbers; each level is written under `state`, and what is there already is not done again."""
    spark, level, found = checker.spark, 1, []
    candidates = first_candidates(spark, ids)
    alike = ~(F.col("od_xy") | F.col("od_yx")) | F.lit(not comparability)
    while True:
        path = f"{state}/level-{level}"
        numbers = read_json(spark, f"{path}.json")
        if numbers is None:
            seen = Observation()
            told = checker.verdicts(candidates).observe(seen, F.count("*").alias("candidates"), *(F.count_if(F.col("ocd") & test).alias(name) for name, test in (("compatible", F.lit(True)), ("xy", F.col("od_xy")), ("yx", F.col("od_yx")), ("alike", alike))))
            told.write.mode("overwrite").parquet(path)
            numbers = seen.get
            # a level is done once its numbers are there
            write_json(spark, f"{path}.json", numbers)
        valid = spark.read.schema(VERDICT_SCHEMA).parquet(path)
        levels.append((level, numbers["candidates"], numbers["compatible"]))
        if not numbers["compatible"]:
            break
        counts["OD"] = counts.get("OD", 0) + numbers["xy"] + numbers["yx"]
        counts["OCD"] = counts.get("OCD", 0) + numbers["alike"]
        found.append(valid.where("ocd"))
        if max_level is not None and level >= max_level or level >= len(ids) - 1:
            break
        longer = expanded(valid.where("ocd AND NOT od_xy"), ids, left=True).unionByName(expanded(valid.where("ocd AND NOT od_yx"), ids, left=False))
        candidates, level = longer.dropDuplicates(), level + 1
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], VERDICT_SCHEMA)
    kind = lambda name, x, y: F.struct(F.lit(name).alias("kind"), F.col(x).alias("x"), F.col(y).alias("y"))
    told = F.array_compact(F.array(F.when(F.col("od_xy"), kind("OD", "x", "y")), F.when(F.col("od_yx"), kind("OD", "y", "x")), F.when(alike, kind("OCD", "x", "y"))))
    return named(every.select(F.inline(told)), checker.columns).select("kind", "lhs", "rhs")


def search(df: DataFrame, columns: Sequence[str], comparability: bool = True, max_level: int | None = None, most_ranks: int = MOST_RANKS, levels: list | None = None) -> DataFrame:
    """kind, lhs, rhs of the dependencies among these columns, which are taken as neither constant nor equivalent.

    With `comparability`, compatible pairs are reported only where neither side orders the other. `max_level`
    ends the search early: level k has candidates of k + 1 columns. Each dependency appears once. Fewer than two
    columns have none.
    """
    spark, names = df.sparkSession, checked_columns(df, columns, allow_empty=True)
    if len(names) < 2:
        return spark.createDataFrame([], RESULT_SCHEMA)
    checker = Checker(df, names, most_ranks)
    found = _search(checker, range(len(names)), comparability, max_level, [] if levels is None else levels, {}, new_path(spark, "search"))
    checker.release()
    return found


def reduction(df: DataFrame, columns: Sequence[str] | None = None, most_ranks: int = MOST_RANKS) -> tuple[list[str], dict[str, list[str]]]:
    """Constant columns, and the others by classes of equivalent ones: the class's first column -> all members."""
    constants, classes, checker = _reduced(df, columns, most_ranks)
    if checker is not None:
        checker.release()
    return constants, classes


def _reduced(df: DataFrame, columns: Sequence[str] | None, most_ranks: int) -> tuple[list[str], dict[str, list[str]], Checker | None]:
    """reduction, and the checker that it used, over the columns that vary; None where there is nothing to check."""
    names = supported_columns(df) if columns is None else checked_columns(df, columns)
    gone = {r["column"] for r in constant_columns(df, names).collect()} if names else set()
    varied = [n for n in names if n not in gone]
    if len(varied) < 2:
        return [n for n in names if n in gone], {n: [n] for n in varied}, None
    checker = Checker(df, varied, most_ranks)
    classes = {varied[r]: [varied[i] for i in members] for r, members in checker.equivalence_classes().items()}
    return [n for n in names if n in gone], classes, checker


def discover(df: DataFrame, columns: Sequence[str] | None = None, comparability: bool = True, max_level: int | None = None, most_ranks: int = MOST_RANKS, state: str | None = None) -> Discovery:
    """All of it: constants, equivalence classes, reduced columns and the dependencies among these. Columns that have no order are left out.

    `state` is a folder that the driver and all executors share. There each finished level is kept, so that a search which ended early
    goes on after its last level when it is started again with the same folder, table and options; a folder of another search is a ValueError.
    """
    began, spark = time.time(), df.sparkSession
    kept = None
    if state is not None:
        about = {"schema": df.schema.jsonValue(), "columns": None if columns is None else list(columns), "comparability": comparability, "rows": df.count()}
        before = read_json(spark, f"{state}/search.json")
        if before is not None and before != about:
            raise ValueError(f"{state} holds another search")
        write_json(spark, f"{state}/search.json", about)
        kept = read_json(spark, f"{state}/reduction.json")
    if kept is None:
        constants, classes, checker = _reduced(df, columns, most_ranks)
        if state is not None:
            write_json(spark, f"{state}/reduction.json", {"constants": constants, "classes": classes})
    else:
        constants, classes, checker = kept["constants"], kept["classes"], None
        names = supported_columns(df) if columns is None else checked_columns(df, columns)
        varied = [n for n in names if n not in constants]
        if len(classes) > 1:
            checker = Checker(df, varied, most_ranks)
    reduced, pruned, levels, counts = list(classes), time.time(), [], {}
    if len(reduced) < 2:
        results = spark.createDataFrame([], RESULT_SCHEMA)
    else:
        ids = [checker.columns.index(n) for n in reduced]
        results = _search(checker, ids, comparability, max_level, levels, counts, new_path(spark, "search") if state is None else state)
    if checker is not None:
        checker.release()
    timings = {"START": began, "PRUNING_START": began, "PRUNING_END": pruned, "RECEIVED_REDUCED_COLUMNS": pruned, "END": time.time()}
    return Discovery(constants, classes, reduced, results, levels, timings, counts)


__all__ = ["SCHEMA", "Discovery", "discover", "reduction", "search"]
