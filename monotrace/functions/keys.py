"""One sort key a column, used for order and equality alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORDERED = (T.StringType, T.IntegralType, T.FractionalType, T.DecimalType, T.DateType, T.BooleanType, T.NullType)


def is_supported(kind: T.DataType) -> bool:
    """Whether columns of a type can be ordered here; arrays, maps, structs and binary cannot."""
    return isinstance(kind, (*_ORDERED, T.TimestampType, T.TimestampNTZType))


def sort_key(df: DataFrame, name: str) -> Column:
    """A column as it is compared: timestamps by whole seconds, all else as it is. Nulls are smallest, NaN is largest."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("second", column)
    if isinstance(kind, T.NullType):
        return column.cast("int")
    return column


def checked_columns(df: DataFrame, names: Sequence[str], allow_empty: bool = False) -> list[str]:
    """The names, if they are columns of df that can be ordered, each once."""
    names = [names] if isinstance(names, str) else list(names)
    if not names and not allow_empty:
        raise ValueError("a list of columns must not be empty")
    for n in names:
        if n not in df.columns:
            raise ValueError(f"no column {n!r}; there are {df.columns}")
        if not is_supported(df.schema[n].dataType):
            raise ValueError(f"column {n!r} of type {df.schema[n].dataType.simpleString()} has no order here")
    return list(dict.fromkeys(names))


def supported_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_supported(f.dataType)]


def keyed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only these columns, as sort keys, named k0, k1, ..."""
    return df.select(*(sort_key(df, n).alias(f"k{i}") for i, n in enumerate(names)))
