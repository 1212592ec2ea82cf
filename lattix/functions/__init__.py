"""Column functions: aggregates over cells and the expression language."""

from .aggregates import AGGREGATES, aggregate_column, clean
from .expressions import compile_expression, parse_expression

__all__ = ["AGGREGATES", "aggregate_column", "clean", "compile_expression", "parse_expression"]
