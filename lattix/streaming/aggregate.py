"""Aggregation over time of rows that keep arriving.

The streaming form of ``aggregate_time``: rows become cells as in ``from_points``, are
windowed by event time and aggregated with a watermark, so state for past slices is
dropped once they can no longer change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import AGGREGATES, aggregate_column, clean, known
from ..ref import CubeRef
from ..timeaxis import Duration, Unit

#: Exact medians and products need a whole group's values, which a stream cannot keep.
STREAMABLE = tuple(f for f in AGGREGATES if f not in ("median", "prod"))


def stream_cells(rows: DataFrame, ref: CubeRef, *, x: Column, y: Column, t: Column, bands: dict[str, Column]) -> DataFrame:
    """``t, iy, ix, bands`` of the rows that lie on the grid; no state."""
    placed = rows.select(t.cast("timestamp").alias("t"), ref.iy_column(y).alias("iy"), ref.ix_column(x).alias("ix"), *[clean(c).alias(b) for b, c in bands.items()])
    return placed.where(F.col("ix").between(0, ref.nx - 1) & F.col("iy").between(0, ref.ny - 1))


def aggregate_stream(cells: DataFrame, bands: list[str], dt: str, func: str = "mean", late: str = "1 hour", every: str | None = None) -> DataFrame:
    """Slices of fixed length ``dt`` (weeks and shorter), by pixel; ``every`` makes them overlap.

    Rows later than ``late`` behind the newest are left out, as Structured Streaming does.
    """
    func = known(func, STREAMABLE)
    step = Duration.parse(dt)
    if step.unit > Unit.WEEK:
        raise ValueError("slices of a stream have a fixed length")
    window = F.window("t", f"{step.count} {step.unit.name.lower()}s", every)
    grouped = cells.withWatermark("t", late).groupBy(window, "iy", "ix")
    out = grouped.agg(*[aggregate_column(func, F.col(f"`{b}`")).alias(b) for b in bands])
    return out.select(F.col("window.start").alias("t0"), F.col("window.end").alias("t1"), "iy", "ix", *[f"`{b}`" for b in bands])
