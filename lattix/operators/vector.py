"""Values of a cube at points and over features.

Points and features become cells first, so everything is an equi join on cells; no
geometry is compared with all cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..crs import transform_columns
from ..cube import KEYS, PIXEL, Cube
from ..functions.aggregates import AGGREGATES, aggregate_column, known
from .geometry import feature_cells


def _located(cube: Cube, points: DataFrame, srs: str | None) -> tuple[Column, Column]:
    x, y = transform_columns(F.col("x").cast("double"), F.col("y").cast("double"), srs, cube.ref.srs)
    return cube.ref.iy_column(y), cube.ref.ix_column(x)


def _time(column: Column) -> Column:
    """Text or timestamps; text may leave out finer parts."""
    text = F.regexp_replace(column.cast("string"), "T", " ")
    full = F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)
    return full.cast("timestamp_ntz")


def query_points(cube: Cube, points: DataFrame, srs: str | None) -> DataFrame:
    """The rows of ``points`` (``x``, ``y``, ``t``) with all bands there; missing outside of the cube."""
    if clash := set(points.columns) & set(cube.bands):
        raise ValueError(f"points have columns named as bands: {', '.join(sorted(clash))}")
    iy, ix = _located(cube, points, srs)
    keyed = points.withColumns({"_it": cube.ref.time.index_column(_time(F.col("t"))), "_iy": iy, "_ix": ix})
    at = cube.df.select(*[F.col(k).alias(f"_{k}") for k in KEYS], *cube.band_columns())
    return keyed.join(at, ["_it", "_iy", "_ix"], "left").select(*points.columns, *cube.band_columns())


def query_timeseries(cube: Cube, points: DataFrame, srs: str | None) -> DataFrame:
    """For every row of ``points`` (``x``, ``y``) and every slice the bands there."""
    names = [c for c in points.columns if c not in ("it", "t")]
    if clash := set(names) & set(cube.bands):
        raise ValueError(f"points have columns named as bands: {', '.join(sorted(clash))}")
    iy, ix = _located(cube, points, srs)
    keyed = points.select(*names).withColumns({"_iy": iy, "_ix": ix})
    every = keyed.withColumn("_it", F.explode(F.sequence(F.lit(0), F.lit(cube.ref.nt - 1))))
    at = cube.df.select(*[F.col(k).alias(f"_{k}") for k in KEYS], *cube.band_columns())
    joined = every.join(at, ["_it", "_iy", "_ix"], "left")
    return joined.select(*names, F.col("_it").alias("it"), cube.ref.time.start_column(F.col("_it")).alias("t"), *cube.band_columns())


def extract(cube: Cube, features: DataFrame, time_column: str | None, srs: str | None) -> DataFrame:
    """``fid, it, iy, ix`` and bands of every covered cell with a value; with a time column, only of each feature's slice."""
    covered = feature_cells(features, cube.ref, srs)
    some = F.coalesce(*cube.band_columns()).isNotNull()
    joined = covered.join(cube.df.where(some), list(PIXEL))
    if time_column:
        times = features.select(F.col("fid").cast("long").alias("fid"), cube.ref.time.index_column(_time(F.col(time_column))).alias("_it"))
        joined = joined.join(times, "fid").where(F.col("it") == F.col("_it"))
    return joined.select("fid", *KEYS, *cube.band_columns())


def zonal_statistics(cube: Cube, features: DataFrame, aggregates: list[tuple[str, str]], srs: str | None) -> DataFrame:
    """Statistics of the cells of every polygon for every slice: ``fid, it, t, <band>_<function>``.

    Cells are summed up by feature and slice before the shuffle. Features without a
    value in a slice have missing statistics, and 0 as count.
    """
    spec = [(known(f, AGGREGATES), b) for f, b in aggregates]
    if not spec:
        raise ValueError("zonal_statistics needs at least one function and band")
    covered = feature_cells(features, cube.ref, srs, polygons_only=True)
    used = list(dict.fromkeys(b for _, b in spec))
    joined = covered.join(cube.df.select(*KEYS, *cube.band_columns(used)), list(PIXEL))
    stats = joined.groupBy("fid", "it").agg(*[aggregate_column(f, cube.band(b), "zonal").alias(f"{b}_{f}") for f, b in spec])
    every = features.select(F.col("fid").cast("long").alias("fid")).withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(cube.ref.nt - 1))))
    columns = [(F.coalesce(F.col(f"`{b}_{f}`"), F.lit(0.0)) if f == "count" else F.col(f"`{b}_{f}`")).alias(f"{b}_{f}") for f, b in spec]
    return every.join(stats, ["fid", "it"], "left").select("fid", "it", cube.ref.time.start_column(F.col("it")).alias("t"), *columns)
