"""Operators along the time series of pixels: windows, kernels and gap filling.

One shuffle by pixel serves densifying and all windows after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..cube import KEYS, PIXEL, Cube
from ..functions.aggregates import known

WINDOW_FUNCTIONS = ("mean", "sum", "prod", "count", "min", "max", "median")
SERIES = W.partitionBy(*PIXEL).orderBy("it")


def dense_rows(cube: Cube) -> DataFrame:
    """Every slice of every pixel that has a row, with the added cells missing.

    Each row stands for the slices up to the next row of its pixel (the first also for
    those before it), so the work is linear in the result and needs no join.
    """
    following = F.coalesce(F.lead("it").over(SERIES), F.lit(cube.ref.nt))
    first = F.when(F.lag("it").over(SERIES).isNull(), 0).otherwise(F.col("it"))
    spread = cube.df.withColumns({"_from": first, "_to": following}).withColumn("_it", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))
    return spread.select(F.col("_it").alias("it"), *PIXEL, *[F.when(F.col("_it") == F.col("it"), cube.band(b)).alias(b) for b in cube.bands])


def densify(cube: Cube) -> Cube:
    return cube.derive(dense_rows(cube))


def _windowed(func: str, value: Column, frame) -> Column:
    if func == "mean":
        return F.avg(value).over(frame)
    if func == "sum":
        return F.coalesce(F.sum(value).over(frame), F.lit(0.0))
    if func == "prod":
        return F.coalesce(F.product(value).over(frame), F.lit(1.0))
    if func == "count":
        return F.count(value).over(frame).cast("double")
    if func == "median":
        return F.percentile(value, 0.5).over(frame)
    return (F.min if func == "min" else F.max)(value).over(frame)


def window_time(cube: Cube, reducers: list[tuple[str, str]] | None, kernel: list[float] | None, left: int, right: int) -> Cube:
    """Functions over slices ``-left`` to ``+right`` of each slice, or a kernel over them.

    Functions skip missing values and give bands ``<band>_<function>``. A kernel has
    ``left + 1 + right`` weights, is applied to every band, keeps names, and is missing
    where any value, also beyond the ends, is.
    """
    if (reducers is None) == (kernel is None):
        raise ValueError("give either functions or a kernel")
    if left < 0 or right < 0:
        raise ValueError("window sizes must not be negative")
    dense = dense_rows(cube)
    sizes = {"win_size_l": left, "win_size_r": right}
    if kernel is not None:
        if len(kernel) != left + 1 + right:
            raise ValueError(f"the kernel needs {left + 1 + right} weights")

        def at(value: Column, offset: int) -> Column:
            return value if not offset else F.lag(value, -offset).over(SERIES) if offset < 0 else F.lead(value, offset).over(SERIES)

        new = [reduce(Column.__add__, [at(cube.band(b), k - left) * float(w) for k, w in enumerate(kernel)]).alias(b) for b in cube.bands]
        return cube.derive(dense.select(*KEYS, *new), plan={"cube_type": "window_time", "kernel": [float(k) for k in kernel], **sizes})
    spec = [(known(f, WINDOW_FUNCTIONS), b) for f, b in reducers]
    frame = SERIES.rowsBetween(-left, right)  # rows are slices here: the series is dense
    new = [_windowed(f, cube.band(b), frame).alias(f"{b}_{f}") for f, b in spec]
    return cube.derive(dense.select(*KEYS, *new), bands=[f"{b}_{f}" for f, b in spec], plan={"cube_type": "window_time", "reducer_bands": [list(x) for x in spec], **sizes})


def fill_time(cube: Cube, method: str) -> Cube:
    """Missing values from the series: ``near`` (the earlier on ties), ``linear`` (the nearest at the ends), ``locf`` or ``nocb``. Distances count slices."""
    if method not in ("near", "linear", "locf", "nocb"):
        raise ValueError(f"unknown method {method!r}")
    dense = dense_rows(cube)
    back = SERIES.rowsBetween(W.unboundedPreceding, 0)
    # the same backwards: a frame that only grows takes each row once
    ahead = W.partitionBy(*PIXEL).orderBy(F.desc("it")).rowsBetween(W.unboundedPreceding, 0)
    it = F.col("it")
    out = []
    for b in cube.bands:
        v = cube.band(b)
        before, after = F.last(v, ignorenulls=True).over(back), F.last(v, ignorenulls=True).over(ahead)
        place = F.when(v.isNotNull(), it)
        from_, to = F.last(place, ignorenulls=True).over(back), F.last(place, ignorenulls=True).over(ahead)
        if method == "locf":
            filled = before
        elif method == "nocb":
            filled = after
        elif method == "near":
            filled = F.when(before.isNull() | ((to - it) < (it - from_)), after).otherwise(before)
        else:
            share = (it - from_) / F.when(to > from_, to - from_)
            filled = F.coalesce(before + (after - before) * share, before, after)
        out.append(F.coalesce(v, filled).alias(b))
    return cube.derive(dense.select(*KEYS, *out), plan={"cube_type": "fill_time", "method": method})
