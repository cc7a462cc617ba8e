"""Connected components of a table of links, as rounds of grouping and joining.

Each round hangs every neighbour of a vertex on the smallest vertex it has met (first the larger
neighbours, then the smaller ones), until a round changes nothing. Every round is written to the
shared folder, so that plans stay short and a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Links that one task thins at once.
LINKS = 500_000


class Forest:
    """Vertices 0..n-1 and the links that connect them: of all that come, as many as are needed."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def added(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of these links connect anew. In each round, every root that links to lower ones takes the lowest."""
        taken, left = [], np.arange(len(a))
        while len(left):
            x, y = self.root[a[left]], self.root[b[left]]
            apart = x != y
            left, x, y = left[apart], x[apart], y[apart]
            if not len(left):
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((low, high))
            first = order[np.concatenate(([True], np.diff(high[order]) != 0))]
            taken.append(left[first])
            self.root[high[first]] = low[first]
            while (above := self.root[self.root]) is not None and (above != self.root).any():
                self.root = above
        return np.concatenate(taken or [np.zeros(0, np.int64)])


def thinned(links: DataFrame, share: int = LINKS) -> DataFrame:
    """a, b: of these links, no more than connect the same vertices within each share of about `share` links.

    Links come in many times where they are found in several ways; components need one way only.
    """
    stored = cut_lineage(links.select("a", "b"))

    def run(batches):
        found = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*found, strict=True) if found else ([], [])))
        vertex = np.unique(np.concatenate((a, b)), return_inverse=True)[1]
        new = Forest(int(vertex.max(initial=0)) + 1).added(vertex[: len(a)], vertex[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    return stored.coalesce(1 + stored.count() // share).mapInArrow(run, "a long, b long")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """vertex, root: the smallest vertex that each linked vertex can reach; a root is not listed under itself.

    Links are numbers in any direction, repeated or not; a link of a vertex with itself, or with null, is
    none. Vertices without links do not appear, so an empty table gives an empty one.
    """
    pairs = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    tree = cut_lineage(pairs.distinct())
    before = _state(tree)
    while before[0]:
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tree = cut_lineage(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        now = _state(tree)
        if now == before:
            break
        before = now
    return tree.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
