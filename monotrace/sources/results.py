"""Results as text lines, files and metrics."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.discovery import Discovery


def dependency_lines(results: DataFrame) -> DataFrame:
    """value: `OD: a, b ↦ c` and `OCD: a ~ b, c`, one line a dependency."""
    sign = F.when(F.col("kind") == "OD", " ↦ ").otherwise(" ~ ")
    return results.select(F.concat("kind", F.lit(": "), F.array_join("lhs", ", "), sign, F.array_join("rhs", ", ")).alias("value"))


def result_lines(spark: SparkSession, found: Discovery) -> DataFrame:
    """value: the constant columns, the equivalences, then the dependencies."""
    head = [f"Constant columns: {', '.join(found.constants)}", "Order equivalent: "]
    head += [f"{r} ↔ {', '.join(m[1:])}" for r, m in found.classes.items() if len(m) > 1]
    return spark.createDataFrame([(line,) for line in head], "value string").unionByName(dependency_lines(found.results))


def write_result_lines(spark: SparkSession, found: Discovery, path: str, to_console: bool = False) -> None:
    """The lines as text files under `path`, which is overwritten."""
    lines = result_lines(spark, found)
    lines.write.mode("overwrite").text(path)
    if to_console:
        for row in lines.toLocalIterator():
            print(row["value"])


def metrics(spark: SparkSession, found: Discovery) -> DataFrame:
    """metric_type, metric, description, value: timings in milliseconds since the epoch (described by their UTC time), and counts of results, which were taken while these were written."""
    rows = [("Timing", k, datetime.fromtimestamp(t, UTC).isoformat(), int(1000 * t)) for k, t in found.timings.items()]
    rows += [
        ("Result", "CCs", "constant columns", len(found.constants)),
        ("Result", "OECs", "order equivalence classes", len(found.classes)),
        ("Result", "OECs of two or more", "order equivalence classes without those of one column", sum(len(m) > 1 for m in found.classes.values())),
        ("Result", "ODs", "order dependencies", found.counts.get("OD", 0)),
        ("Result", "OCDs", "order compatibility dependencies", found.counts.get("OCD", 0)),
        ("Result", "candidates", "candidates checked", sum(n for _, n, _ in found.levels)),
    ]
    return spark.createDataFrame(rows, "metric_type string, metric string, description string, value long")
