"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut_lineage, delete, new_path, shared_dir, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone (a null text is the empty text), whatever other columns there are."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def runs_of(numbers: str) -> tuple[Column, Column]:
    """First and last of each run of consecutive numbers, as two arrays, of a column that holds a sorted array of them."""
    n = F.col(numbers)
    begin = F.filter(n, lambda x, i: (i == 0) | (F.get(n, i - 1) != x - 1))
    end = F.filter(n, lambda x, i: (i == F.size(n) - 1) | (F.get(n, i + 1) != x + 1))
    return begin, end


__all__ = ["cut_lineage", "delete", "fresh", "id_and_text", "new_path", "runs_of", "shared_dir", "stored", "table"]
