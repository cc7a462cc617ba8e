"""Verdicts on candidates: many checks over one table, as a table of candidates.

A bounded sample refutes most candidates: its violations are violations of the whole. What it leaves is
checked over all distinct rows. Where these are few enough, in rows and in bytes measured before anything is
collected, they are encoded once, each column as dense ranks, and given to every task; the candidates
are the rows that Spark deals out. Larger tables are encoded on the cluster; rows that stand close together
in the order of a column then refute what distant ones did not, and all other candidates of a level are
checked in one job over the stored ranks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import sort_key
from ..operators.codes import VERDICT_SCHEMA, Codes
from ..operators.ranks import SAMPLE_ROWS, Ranked, encode, row_bytes, sampled
from ..storage import cut_lineage, stored

#: Ranks (rows x columns, 4 bytes each) that are given to every task at most, and bytes of values that are collected to make them.
MOST_RANKS, MOST_BYTES = 16_000_000, 128 << 20


def with_verdicts(candidates: DataFrame, *shared) -> DataFrame:
    """The candidates with ocd, od_xy, od_yx, by ranks that broadcast variables hold; what one of them refutes is not asked of the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranked = [Ranked(s.value) for s in shared]

        def verdict(x: tuple[int, ...], y: tuple[int, ...]) -> tuple[bool, bool, bool]:
            every = True, True, True
            for r in ranked:
                every = tuple(a and b for a, b in zip(every, r.verdict(x, y), strict=True))
                if not every[0]:
                    break
            return every

        for batch in batches:
            rows = [(list(x), list(y), *verdict(tuple(x), tuple(y))) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield pd.DataFrame(rows, columns=["x", "y", "ocd", "od_xy", "od_yx"])

    return candidates.mapInPandas(run, VERDICT_SCHEMA)


class Checker:
    """Verdicts on candidates over one table and a list of its columns, which candidates name by their places."""

    def __init__(self, df: DataFrame, columns: Sequence[str], most_ranks: int = MOST_RANKS):
        self.columns, self.spark = list(columns), df.sparkSession
        self.df, self.rows, size = self._distinct(df)
        self.whole = self.rows * max(1, len(self.columns)) <= most_ranks and size <= MOST_BYTES
        self.small = self.whole and self.rows <= SAMPLE_ROWS
        #: (candidates, left by the sample, left by close rows too) of each call of `verdicts` on a table beyond the bound; once close rows are known, both are asked at once.
        self.left: list[tuple[int, int, int]] = []
        # of the rows to check, never of the table they stand for: their number tells how many the driver gets
        self.head = self.spark.sparkContext.broadcast(encode(self.df if self.small else sampled(self.df, self.columns, self.rows), self.columns))

    def _distinct(self, df: DataFrame) -> tuple[DataFrame, int, int]:
        """The rows to check, how many they are, and bytes of their values.

        A repeated row shows no violation that the first of them does not, so that a large table of which most rows repeat is replaced by
        its distinct rows, as they are compared. An estimate made while rows are counted tells whether that pays.
        """
        counts = F.count("*"), F.coalesce(F.sum(row_bytes(df, self.columns)), F.lit(0))
        keys = [sort_key(df, c).alias(c) for c in self.columns]
        rows, size, apart = df.agg(*counts, F.approx_count_distinct(F.xxhash64(*keys))).first()
        if rows <= SAMPLE_ROWS or 2 * apart > rows:
            return df, rows, size
        df = stored(df.select(*keys).distinct(), "distinct-rows")
        return df, *df.agg(*counts).first()

    @cached_property
    def every(self):
        return self.head if self.small else self.spark.sparkContext.broadcast(encode(self.df, self.columns))

    @cached_property
    def codes(self) -> Codes:
        return Codes(self.df, self.columns)

    @cached_property
    def close(self):
        """Rows that stand close together in the order of a column, of a table whose ranks are on the cluster."""
        return self.spark.sparkContext.broadcast(self.codes.close_rows(SAMPLE_ROWS))

    def verdicts(self, candidates: DataFrame) -> DataFrame:
        tasks = self.spark.sparkContext.defaultParallelism
        # what an earlier call had to make is asked in the same pass
        known = [name for name in ("every", "close") if name in self.__dict__]
        first = with_verdicts(candidates.repartition(tasks), self.head, *(self.__dict__[name] for name in known))
        if self.small or "every" in known:
            return first
        first = cut_lineage(first)
        refuted, left = first.where("NOT ocd"), first.where("ocd").select("x", "y")
        if self.whole:
            return refuted if left.isEmpty() else refuted.unionByName(with_verdicts(left.repartition(tasks), self.every))
        asked, first_left = first.agg(F.count("*"), F.count_if("ocd")).first()
        if first_left and not known and self.close.value.shape[1]:
            again = cut_lineage(with_verdicts(left.repartition(tasks), self.close))
            refuted, left = refuted.unionByName(again.where("NOT ocd")), again.where("ocd").select("x", "y")
        pairs = [(tuple(r["x"]), tuple(r["y"])) for r in left.collect()]  # column numbers alone: the plan is made from them
        self.left.append((asked, first_left, len(pairs)))
        return refuted.unionByName(self.codes.verdicts(pairs)) if pairs else refuted

    def equivalence_classes(self) -> dict[int, list[int]]:
        """Columns that order each other, by their smallest member; a column that has no such other is a class of its own.

        Their ranks are the same in every row. Columns that differ in the sample are told apart by it; the others are compared over all rows.
        """
        alike: dict[bytes, list[int]] = defaultdict(list)
        for i, ranks in enumerate(self.head.value):
            alike[ranks.tobytes()].append(i)
        groups = [g for g in alike.values() if len(g) > 1]
        if groups and not self.small:
            if self.whole:
                alike = defaultdict(list)
                for g in groups:
                    for i in g:
                        alike[self.every.value[i].tobytes()].append(i)
                groups = [g for g in alike.values() if len(g) > 1]
            else:
                groups = self.codes.equivalent(groups)
        classes = {min(g): sorted(g) for g in groups}
        later = {i for g in classes.values() for i in g[1:]}
        return {i: classes.get(i, [i]) for i in range(len(self.columns)) if i not in later}

    def release(self) -> None:
        """Takes the ranks back from the tasks' machines."""
        for name in ("head", "every", "close"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()
