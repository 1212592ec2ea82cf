"""Putting an image's pixels on a grid.

Nearest neighbour gives a pixel's value to the cells whose centre lies in it. The
statistics (average, min, max, mode, med, q1, q3) take the pixels whose centre lies
in a cell. The kernels (bilinear, cubic, cubicspline, lanczos) weigh the pixels around
a cell's centre, and widen with the cell where cells are larger than pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..crs import transform_columns
from ..ref import CubeRef

ALIASES = {"nearest": "near", "mean": "average", "median": "med"}
STATISTICS = {
    "average": F.avg,
    "min": F.min,
    "max": F.max,
    "mode": lambda v: F.mode(v, deterministic=True),
    "med": F.median,
    "q1": lambda v: F.percentile(v, 0.25),
    "q3": lambda v: F.percentile(v, 0.75),
}


def _triangle(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d)


def _cubic(d: Column) -> Column:
    a = -0.5
    return F.when(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1).when(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a).otherwise(0.0)


def _spline(d: Column) -> Column:
    return F.when(d <= 1, 2 / 3 - d**2 + d**3 / 2).when(d < 2, (2 - d) ** 3 / 6).otherwise(0.0)


def _lanczos(d: Column) -> Column:
    x = d * math.pi
    return F.when(d < 1e-9, 1.0).when(d < 3, 3 * F.sin(x) * F.sin(x / 3) / (x * x)).otherwise(0.0)


KERNELS = {"bilinear": (1, _triangle), "cubic": (2, _cubic), "cubicspline": (2, _spline), "lanczos": (3, _lanczos)}


def method_name(name: str) -> str:
    name = ALIASES.get(name, name)
    if name != "near" and name not in STATISTICS and name not in KERNELS:
        raise ValueError(f"unknown resampling {name!r}")
    return name


def _cells(low: Column, high: Column, origin: float, size: float, n: int) -> tuple[Column, Column]:
    """First and last cell whose centre lies within [low, high)."""
    first = F.greatest(F.lit(0), F.ceil((low - origin) / size - 0.5).cast("int"))
    last = F.least(F.lit(n - 1), (F.ceil((high - origin) / size - 0.5) - 1).cast("int"))
    return first, last


def resample(pixels: DataFrame, keys: list[str], bands: list[str], r: CubeRef, method: str, srs: str | None = None) -> DataFrame:
    """``keys, iy, ix, bands`` from pixels with centres ``x``, ``y`` and sizes ``dx``, ``dy`` (NULL: points)."""
    method = method_name(method)
    x, y = transform_columns(F.col("x"), F.col("y"), srs, r.srs)
    if method in STATISTICS:
        placed = pixels.select(*keys, r.iy_column(y).alias("iy"), r.ix_column(x).alias("ix"), *[f"`{b}`" for b in bands]).where(F.col("ix").between(0, r.nx - 1) & F.col("iy").between(0, r.ny - 1))
        return placed.groupBy(*keys, "iy", "ix").agg(*[STATISTICS[method](F.col(f"`{b}`")).alias(b) for b in bands])
    # edges of the pixel on the grid's axes
    left, bottom = transform_columns(F.col("x") - F.col("dx") / 2, F.col("y") - F.col("dy") / 2, srs, r.srs)
    right, top = transform_columns(F.col("x") + F.col("dx") / 2, F.col("y") + F.col("dy") / 2, srs, r.srs)
    values = [F.col(f"`{b}`") for b in bands]
    if method == "near":
        fx, lx = _cells(left, right, r.left, r.dx, r.nx)
        fy, ly = _cells(-top, -bottom, -r.top, r.dy, r.ny)
        point = F.col("dx").isNull() | F.col("dy").isNull()
        px, py = r.ix_column(x), r.iy_column(y)
        ranged = pixels.select(*keys, *values, F.when(point, px).otherwise(fx).alias("fx"), F.when(point, px).otherwise(lx).alias("lx"), F.when(point, py).otherwise(fy).alias("fy"), F.when(point, py).otherwise(ly).alias("ly"))
        ranged = ranged.where((F.col("fx") <= F.col("lx")) & (F.col("fy") <= F.col("ly")) & (F.col("fx") >= 0) & (F.col("fy") >= 0) & (F.col("lx") < r.nx) & (F.col("ly") < r.ny))
        across = ranged.withColumn("ix", F.explode(F.sequence("fx", "lx")))
        return across.withColumn("iy", F.explode(F.sequence("fy", "ly"))).select(*keys, "iy", "ix", *values)
    radius, weigh = KERNELS[method]
    wide_x = F.greatest(F.abs(right - left), F.lit(r.dx))
    wide_y = F.greatest(F.abs(top - bottom), F.lit(r.dy))
    fx, lx = _cells(x - wide_x * radius, x + wide_x * radius, r.left, r.dx, r.nx)
    fy, ly = _cells(-y - wide_y * radius, -y + wide_y * radius, -r.top, r.dy, r.ny)
    spread = pixels.select(*keys, *values, x.alias("_x"), y.alias("_y"), wide_x.alias("_wx"), wide_y.alias("_wy"), fx.alias("fx"), lx.alias("lx"), fy.alias("fy"), ly.alias("ly")).where("fx <= lx and fy <= ly")
    spread = spread.withColumn("ix", F.explode(F.sequence("fx", "lx"))).withColumn("iy", F.explode(F.sequence("fy", "ly")))
    w = weigh(F.abs(r.left + (F.col("ix") + 0.5) * r.dx - F.col("_x")) / F.col("_wx")) * weigh(F.abs(r.top - (F.col("iy") + 0.5) * r.dy - F.col("_y")) / F.col("_wy"))
    weighed = spread.withColumn("_w", w)
    out = [F.try_divide(F.sum(v * F.col("_w")), F.sum(F.when(v.isNotNull(), F.col("_w")))).alias(b) for v, b in zip(values, bands, strict=True)]
    return weighed.groupBy(*keys, "iy", "ix").agg(*out)
