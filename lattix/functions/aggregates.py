"""Aggregates over cells. Missing values are NULL; NaN never reaches an aggregate.

Three families differ for groups without a value: ``reduce`` gives 0, 1 and 0 for
sum, prod and count, ``aggregate`` gives NULL, NULL and 0, ``zonal`` is as aggregate but
with population variance (NULL below two values) and skips infinities.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES = ("sum", "prod", "mean", "min", "max", "count", "median", "var", "sd")
REDUCERS = (*AGGREGATES, "which_min", "which_max", "Q1", "Q3")
ALIASES = {"q1": "Q1", "q3": "Q3"}


def clean(value: Column) -> Column:
    """As DOUBLE with NaN as NULL."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def known(func: str, allowed: tuple[str, ...]) -> str:
    func = ALIASES.get(func, func)
    if func not in allowed:
        raise ValueError(f"unknown function {func!r}; known are {', '.join(allowed)}")
    return func


def aggregate_column(func: str, value: Column, family: str = "aggregate", it: Column | None = None) -> Column:
    """An aggregate of a NULL-cleaned DOUBLE column.

    ``which_min`` and ``which_max`` give the earliest slice index of the extreme; they
    need ``it``.
    """
    if family == "zonal":
        value = finite(value)
    if func == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0)) if family == "reduce" else F.sum(value)
    if func == "prod":
        return F.coalesce(F.product(value), F.lit(1.0)) if family == "reduce" else F.product(value)
    if func == "mean":
        return F.avg(value)
    if func == "min":
        return F.min(value)
    if func == "max":
        return F.max(value)
    if func == "count":
        return F.count(value).cast("double")
    if func == "median":
        return F.median(value)
    if func == "Q1":
        return F.percentile(value, 0.25)
    if func == "Q3":
        return F.percentile(value, 0.75)
    if func in ("var", "sd") and family == "zonal":
        return F.when(F.count(value) >= 2, (F.var_pop if func == "var" else F.stddev_pop)(value))
    if func == "var":
        return F.var_samp(value)
    if func == "sd":
        return F.stddev_samp(value)
    if func == "which_min":
        return F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), it.alias("it"))))["it"]
    if func == "which_max":
        return -F.max(F.when(value.isNotNull(), F.struct(value.alias("v"), (-it).alias("it"))))["it"]
    raise ValueError(func)
