"""CSV files as typed tables: format found from the head of the file, types from the first rows."""

from __future__ import annotations

import csv
import string
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.inference import RANKS, inferred, parsed
from .records import lines_of, open_splits, records

DELIMITERS = (",", ";", "\t", "|", ":", " ")
_HEAD = 200


def synthetic_names(n: int) -> list[str]:
    """A, B, ..., Z, AA, AB, ..."""
    names = []
    for k in range(1, n + 1):
        name = ""
        while k:
            k, rest = divmod(k - 1, 26)
            name = string.ascii_uppercase[rest] + name
        names.append(name)
    return names


def find_delimiter(lines: list[str]) -> str:
    """The character that cuts the most of these lines into the same number of fields, more than one; a comma where none does."""
    best = (0.0, 0, ",")
    for rank, d in enumerate(DELIMITERS):
        widths = Counter(len(row) for row in csv.reader(lines, delimiter=d) if row)
        if widths:
            width, n = max(widths.items(), key=lambda x: (x[1], x[0]))
            if width > 1:
                best = max(best, (n / sum(widths.values()), -rank, d))
    return best[2]


def find_quote(lines: list[str], delimiter: str) -> str:
    """The character, " or ', that stands at both ends of the most fields of these lines; a double quote where neither does."""
    fields = [f.strip() for line in lines for f in line.split(delimiter)]
    return max(('"', "'"), key=lambda q: sum(len(f) > 1 and f[0] == f[-1] == q for f in fields))


def infer_types(rows: DataFrame, names: list[str]) -> dict[str, tuple[str, str | None]]:
    """Type and date format of each text column: the highest rank, and the format first met at that rank.

    `rows` holds the rows to look at, numbered by a column `_idx`; one aggregate looks at all of them.
    """
    kinds = list(RANKS)
    best = [F.max_by(F.struct(F.col(f"t{i}.rank").alias("rank"), F.col(f"t{i}.format").alias("format")), F.struct(F.col(f"t{i}.rank"), -F.col("_idx"))).alias(f"b{i}") for i in range(len(names))]
    found = rows.select("_idx", *(inferred(F.col(f"`{n}`")).alias(f"t{i}") for i, n in enumerate(names))).agg(*best).first()
    return {n: ("null", None) if found[f"b{i}"] is None else (kinds[found[f"b{i}"]["rank"]], found[f"b{i}"]["format"]) for i, n in enumerate(names)}


def typed(texts: DataFrame, types: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Text columns read as their types, in one projection."""
    return texts.select(*(parsed(F.col(f"`{n}`"), kind, form).alias(n) for n, (kind, form) in types.items()))


def lost_values(texts: DataFrame, types: dict[str, tuple[str, str | None]]) -> DataFrame:
    """One row a column: the values that are no null token but could not be read as the column's type."""
    from ..functions.inference import is_null_token

    counts = [F.count_if(~is_null_token(F.col(f"`{n}`")) & parsed(F.col(f"`{n}`"), kind, form).isNull()).alias(n) for n, (kind, form) in types.items()]
    return texts.agg(*counts).unpivot([], list(types), "column", "lost")


def read_csv(spark: SparkSession, path: str, header: bool = False, infer_rows: int = 1000, delimiter: str | None = None, quote: str | None = None, multiline: bool | None = None) -> DataFrame:
    """A typed table of a CSV file or folder.

    Delimiter and quote are found from the head of the file unless given. Without a header columns are named
    A, B, ... Types come from the first `infer_rows` rows; later values that do not fit become null. Short rows
    are filled with nulls. An empty file is a ValueError. Lines end in a line feed, a carriage return or both.
    Where quoted values hold line feeds, as a pass over the lines tells unless `multiline` does, rows are put together from lines
    (`records`) and kept in the shared folder; such files are split as well.
    """
    if infer_rows < 1:
        raise ValueError("infer_rows must be 1 or more")
    lines = lines_of(spark, path)
    if delimiter is None or quote is None:
        head = [r[0] for r in lines.select("value").take(_HEAD)]
        delimiter = find_delimiter(head) if delimiter is None else delimiter
        quote = find_quote(head, delimiter) if quote is None else quote
    options = {"sep": delimiter, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    inside = None
    if multiline is not False and not lines.where(F.contains("value", F.lit(quote))).limit(1).isEmpty():
        found, inside = open_splits(lines, delimiter, quote)
        inside = inside if found or multiline else None
    if inside is None:
        texts = spark.read.csv(path, header=header, inferSchema=False, multiLine=False, encoding="UTF-8", **options)
    else:
        texts = _cut(records(lines, inside, delimiter, quote), header, options)
    if not texts.columns:
        raise ValueError(f"{path} holds no columns")
    if not header:
        texts = texts.toDF(*synthetic_names(len(texts.columns)))
    # the first rows of a scan are those of its first file; their number is bounded by infer_rows
    first = texts.limit(infer_rows).withColumn("_idx", F.monotonically_increasing_id())
    return typed(texts, infer_types(first, texts.columns))


def _cut(rows: DataFrame, header: bool, options: dict) -> DataFrame:
    """Rows as texts cut into their fields; blank ones are none. Names, and how many columns there are, come from a file's first row."""
    rows = rows.where(F.trim("value") != "")
    head = rows.where("first").limit(1).first() or rows.limit(1).first()
    if head is None:
        return rows.select()
    names = next(csv.reader(head["value"].split("\n"), delimiter=options["sep"], quotechar=options["quote"], skipinitialspace=True))
    names = [n.strip() or f"_c{i}" for i, n in enumerate(names)] if header else [f"_c{i}" for i in range(len(names))]
    schema = StructType([StructField(f"_c{i}", StringType()) for i in range(len(names))])
    kept = rows.where(~F.col("first")) if header else rows
    return kept.select(F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).alias("r")).select("r.*").toDF(*names)


def from_texts(spark: SparkSession, columns: dict[str, list[str | None]]) -> DataFrame:
    """A typed table of columns given as texts, types inferred from all of them."""
    names = list(columns)
    rows = list(zip(*columns.values(), strict=True))
    texts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_idx long, " + ", ".join(f"`{n}` string" for n in names))
    return typed(texts, infer_types(texts, names))
