"""Order-dependency profiling on Spark."""

from .operators.checks import check_constant, check_equivalent, check_ocd, check_od, column_profile, constant_columns, od_violations, order_compatible_pairs
from .operators.ordering import ordered_indices, ordered_indices_by, sorted_column, sorted_with_indices
from .plans.discovery import Discovery, discover, search
from .sources.csv import read_csv
from .sources.results import metrics, result_lines, write_result_lines

__all__ = [
    "Discovery",
    "check_constant",
    "check_equivalent",
    "check_ocd",
    "check_od",
    "column_profile",
    "constant_columns",
    "discover",
    "metrics",
    "od_violations",
    "order_compatible_pairs",
    "ordered_indices",
    "ordered_indices_by",
    "read_csv",
    "result_lines",
    "search",
    "sorted_column",
    "sorted_with_indices",
    "write_result_lines",
]
__version__ = "0.1.0"
