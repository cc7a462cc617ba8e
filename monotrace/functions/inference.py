"""Types of text values: which one a value has, and how it is read as that type.

Ranks order the types; over a column the highest rank wins, and values that cannot be read as the winner become null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The types by rank, and the date formats of each rank in the order in which they are tried.
RANKS = {"null": 0, "string": 1, "long": 2, "double": 3, "date": 4, "datetime": 5, "zoned": 6}
_TIME = r"\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
_ZONE = r"(?:Z|[+-]\d{2}:\d{2}(?::\d{2})?)(?:\[[A-Za-z0-9/_+-]+\])?"
_DAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


@dataclass(frozen=True)
class DateFormat:
    name: str
    type: str
    pattern: str


DATE_FORMATS = (
    DateFormat("iso_zoned", "zoned", rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_TIME}{_ZONE}$"),
    DateFormat("rfc_1123", "zoned", rf"^{_DAY}\d{{1,2}} {_MONTH} \d{{4}} \d{{2}}:\d{{2}}(?::\d{{2}})? (?:GMT|[+-]\d{{4}})$"),
    DateFormat("iso_local", "datetime", rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_TIME}$"),
    DateFormat("us", "date", r"^\d{2}/\d{2}/\d{4}$"),
    DateFormat("iso_date", "date", r"^\d{4}-\d{2}-\d{2}(?:Z|[+-]\d{2}:\d{2})?$"),
)
_SQL_TYPES = {"null": "string", "string": "string", "long": "bigint", "double": "double", "date": "date", "datetime": "timestamp_ntz", "zoned": "timestamp"}


def is_null_token(value: Column) -> Column:
    return value.isNull() | (value == "") | (F.lower(value) == "null") | (value == "?")


def read_date(value: Column, form: DateFormat) -> Column:
    """A text in this format as date or timestamp; null where it is not one, or no such day exists."""
    fits = F.regexp_like(value, F.lit(form.pattern))
    if form.name == "iso_zoned":
        # seconds may be left out, and so may the name of the zone
        got = F.regexp_replace(F.regexp_replace(value, r"\[[^\]]*\]$", ""), r"^(.{13}:\d{2})(Z|[+-])", "$1:00$2").try_cast("timestamp")
    elif form.name == "rfc_1123":
        plain = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]{3}, ", ""), r"GMT$", "+0000")
        plain = F.regexp_replace(plain, r" (\d{2}:\d{2}) ([+-])", " $1:00 $2")
        got = F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss xx"))
        day = F.regexp_extract(value, r"^([A-Za-z]{3}), ", 1)
        # the day's name is that of the date as written, not of the instant in the session's zone
        written = F.try_to_date(F.regexp_extract(plain, r"^(\d{1,2} [A-Za-z]{3} \d{4})", 1), "d MMM yyyy")
        got = F.when((day == "") | (day == F.date_format(written, "E")), got)
    elif form.name == "iso_local":
        got = value.try_cast("timestamp_ntz")
    elif form.name == "us":
        got = F.try_to_date(value, "MM/dd/yyyy")
    else:
        got = F.substring(value, 1, 10).try_cast("date")
    return F.when(fits, got)


def is_long(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"^[+-]?\d+$")) & value.try_cast("bigint").isNotNull()


def is_double(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"^[^\s]+$")) & value.try_cast("double").isNotNull()


def inferred(value: Column) -> Column:
    """Struct of rank and format (null but for dates) of one text."""
    as_struct = lambda kind, form=None: F.struct(F.lit(RANKS[kind]).alias("rank"), F.lit(form).cast("string").alias("format"))
    out = F.when(is_null_token(value), as_struct("null"))
    for form in DATE_FORMATS:
        out = out.when(read_date(value, form).isNotNull(), as_struct(form.type, form.name))
    return out.when(is_long(value), as_struct("long")).when(is_double(value), as_struct("double")).otherwise(as_struct("string"))


def type_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RANKS)), rank + 1)


def parsed(value: Column, kind: str, form: str | None = None) -> Column:
    """A text read as a type, null where that fails and for null tokens."""
    if kind in ("date", "datetime", "zoned"):
        got = read_date(value, next(f for f in DATE_FORMATS if f.name == form))
    elif kind == "long":
        got = F.when(is_long(value), value.try_cast("bigint"))
    elif kind == "double":
        got = F.when(is_double(value), value.try_cast("double"))
    else:
        got = value if kind == "string" else F.lit(None)
    return F.when(~is_null_token(value), got).cast(_SQL_TYPES[kind])
