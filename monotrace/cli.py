"""Command line: spark-submit monotrace/cli.py --input table.csv --output results"""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Find the order dependencies of a table.")
    parser.add_argument("--input", required=True, help="CSV file, or Parquet where the name ends in .parquet")
    parser.add_argument("--has-header", action="store_true")
    parser.add_argument("--output", required=True, help="folder for the result lines; overwritten")
    parser.add_argument("--inferring-rows", type=int, default=1000)
    parser.add_argument("--delimiter")
    parser.add_argument("--max-level", type=int)
    parser.add_argument("--all-ocds", action="store_true", help="report compatible lists even where one orders the other")
    parser.add_argument("--output-to-console", action="store_true")
    given = parser.parse_args(args)

    from pyspark.sql import SparkSession

    from monotrace import discover, metrics, read_csv, write_result_lines

    spark = SparkSession.builder.appName("monotrace").getOrCreate()
    table = spark.read.parquet(given.input) if given.input.endswith(".parquet") else read_csv(spark, given.input, given.has_header, given.inferring_rows, given.delimiter)
    found = discover(table, comparability=not given.all_ocds, max_level=given.max_level)
    write_result_lines(spark, found, given.output, given.output_to_console)
    print("MetricType,Metric,Description,Value")
    for r in metrics(spark, found).toLocalIterator():
        print(",".join(map(str, r)))


if __name__ == "__main__":
    main()
