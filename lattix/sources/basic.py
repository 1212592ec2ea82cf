"""Cubes from rows, from aligned frames, and constant cubes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from ..crs import same, transform_columns
from ..cube import KEYS, Cube, cells
from ..functions.aggregates import aggregate_column, clean
from ..ref import CubeRef, CubeView
from ..timeaxis import Duration, LabeledTime, Time, parse_time


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_points(df: DataFrame, ref: CubeRef, *, x: str | Column, y: str | Column, t: str | Column, bands: dict[str, str | Column], func: str = "mean", srs: str | None = None) -> Cube:
    """Cells from rows with coordinates; rows of one cell are aggregated by ``func``. Rows outside go, by their raw coordinates already in the scan."""
    px, py = _column(x).cast("double"), _column(y).cast("double")
    cx, cy = transform_columns(px, py, srs, ref.srs)
    place = {"ix": ref.ix_column(cx), "iy": ref.iy_column(cy), "it": ref.time.index_column(_column(t))}

    def bounds(r: CubeRef) -> Column:
        near = time_bounds(_column(t), r)
        if not same(srs, r.srs):
            return near
        return near & (_column(x) >= r.left - r.dx) & (_column(x) <= r.right + r.dx) & (_column(y) >= r.bottom - r.dy) & (_column(y) <= r.top + r.dy)

    return _aggregated(df, ref, place, bands, func, bounds, (0, 0, 0))


def from_cells(df: DataFrame, ref: CubeRef, *, ix: str | Column, iy: str | Column, it: str | Column | None = None, t: str | Column | None = None, bands: dict[str, str | Column], func: str = "mean") -> Cube:
    """Cells from rows with indices, and a slice's index ``it`` or a time ``t`` that the scan can filter by."""
    if (it is None) == (t is None):
        raise ValueError("give either it or t")
    place = {"ix": _column(ix), "iy": _column(iy), "it": ref.time.index_column(_column(t)) if it is None else _column(it)}
    bounds = (lambda r: F.lit(True)) if t is None else (lambda r: time_bounds(_column(t), r))
    return _aggregated(df, ref, place, bands, func, bounds, (0, 0, 0))


def time_bounds(t: Column, ref: CubeRef) -> Column:
    """Whether a time may lie within a reference: comparisons of the raw column, which reach file scans."""
    if isinstance(ref.time, LabeledTime):
        low, last = (f(ref.time.times, key=lambda x: x.value) for f in (min, max))
    else:
        low, last = ref.time.at(0), ref.time.at(ref.nt - 1)
    step = ref.time.dt or Duration(1, ref.time.unit)
    end = (Time(last.value, step.unit) + step).value
    start = Time(low.value, ref.time.unit).truncate(ref.time.unit).value
    return (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz"))


def _aggregated(df: DataFrame, ref: CubeRef, place: dict[str, Column], bands: dict[str, str | Column], func: str, bounds: Callable[[CubeRef], Column], low: tuple[int, int, int]) -> Cube:
    """One partial aggregation before the shuffle. ``low`` are the indices (it, iy, ix) of the first cell.

    A crop of the cube starts again from the rows, so that its bounds reach the scan too.
    """
    shifted = [(place[k].cast("int") - F.lit(n)).alias(k) if n else place[k].cast("int").alias(k) for k, n in zip(KEYS, low, strict=True)]
    keyed = df.where(bounds(ref)).select(*shifted, *[clean(_column(c)).alias(b) for b, c in bands.items()])
    inside = keyed.where(F.col("ix").between(0, ref.nx - 1) & F.col("iy").between(0, ref.ny - 1) & F.col("it").between(0, ref.nt - 1))
    cube = Cube(inside.groupBy(*KEYS).agg(*[aggregate_column(func, F.col(f"`{b}`")).alias(b) for b in bands]), ref, list(bands))
    cube.remake = lambda r, first: _aggregated(df, r, place, bands, func, bounds, tuple(a + b for a, b in zip(low, first, strict=True)))
    return cube


def _grid(spark: SparkSession, ref: CubeRef) -> DataFrame:
    """All cells of a grid, made where they are needed."""
    plane = ref.nx * ref.ny
    i = F.col("id")
    return spark.range(ref.nt * plane).select(F.floor(i / plane).cast("int").alias("it"), F.floor(F.pmod(i, F.lit(plane)) / ref.nx).cast("int").alias("iy"), F.pmod(i, F.lit(ref.nx)).cast("int").alias("ix"))


def dummy(spark: SparkSession, view: CubeView | CubeRef, nbands: int = 1, fill: float = 1.0) -> Cube:
    """Every cell holds ``fill`` in bands band1, band2, ..."""
    view = view if isinstance(view, CubeView) else CubeView(view)
    bands = [f"band{k + 1}" for k in range(nbands)]
    df = _grid(spark, view.ref).select(*KEYS, *[clean(F.lit(float(fill))).alias(b) for b in bands])
    return Cube(df, view.ref, bands, {"cube_type": "dummy", "view": view.to_json(), "nbands": nbands, "fill": float(fill)})


def empty(spark: SparkSession, view: CubeView | CubeRef, nbands: int = 1) -> Cube:
    """A cube without a value."""
    view = view if isinstance(view, CubeView) else CubeView(view)
    bands = [f"band{k + 1}" for k in range(nbands)]
    df = spark.createDataFrame([], ", ".join([f"{k} int" for k in KEYS] + [f"{b} double" for b in bands]))
    return Cube(df, view.ref, bands, {"cube_type": "empty", "view": view.to_json(), "nbands": nbands})


def from_frames(frames: list[tuple[str, DataFrame]], ref: CubeRef, bands: list[str]) -> Cube:
    """Aligned rasters ``(time, frame of iy, ix and bands)`` without resampling.

    Slices are the sorted distinct times. Where several frames have one time, the later
    frame's value of a band counts, value by value as far as it has the band.
    """
    if not frames:
        raise ValueError("no frame is given")
    times = sorted({parse_time(t) for t, _ in frames}, key=lambda t: t.value)
    place = {t.value: i for i, t in enumerate(times)}
    parts = []
    for order, (t, f) in enumerate(frames):
        columns = [clean(F.col(f"`{b}`")).alias(b) if b in f.columns else F.lit(None).cast("double").alias(b) for b in bands]
        has = [F.lit(b in f.columns).alias(f"_has_{k}") for k, b in enumerate(bands)]
        parts.append(f.select(F.lit(place[parse_time(t).value]).alias("it"), F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), F.lit(order).alias("_order"), *columns, *has))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    ref = ref.with_(time=LabeledTime(tuple(times)))
    if len(frames) == len(times):  # nothing to settle, no shuffle
        return cells(whole, ref, bands)
    latest = [F.max_by(F.col(f"`{b}`"), F.when(F.col(f"_has_{k}"), F.col("_order"))).alias(b) for k, b in enumerate(bands)]
    return cells(whole.groupBy(*KEYS).agg(*latest), ref, bands)


def read_cube(spark: SparkSession, path: str) -> Cube:
    """A cube as ``sinks.write_cube`` wrote it."""
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/about.json").collect())
    about = json.loads(text)
    ref = CubeView.from_json(about["view"]).ref if about["labels"] is None else None
    if ref is None:
        s = about["view"]["space"]
        ref = CubeRef(s["left"], s["right"], s["bottom"], s["top"], s["nx"], s["ny"], s["srs"], LabeledTime(tuple(parse_time(t) for t in about["labels"])))
    bands = about["bands"]
    kind = ", ".join([f"{k} int" for k in KEYS] + [f"`{b}` double" for b in bands] + ["_tile int"])
    df = spark.read.schema(kind).parquet(f"{path}/cells").select(*KEYS, *[f"`{b}`" for b in bands])
    return Cube(df, ref, bands)


