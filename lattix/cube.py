"""A data cube: a DataFrame of cells on a space-time reference.

Cells are rows ``it, iy, ix, <band> ...`` with DOUBLE bands; ``iy`` counts from the
top. A cell without a row is the same as one whose bands are all NULL. Operators are
lazy and return new cubes; nothing runs before an action on ``df``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.aggregates import clean
from .ref import CubeRef
from .timeaxis import RegularTime

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

KEYS = ("it", "iy", "ix")
PIXEL = ("iy", "ix")


class Cube:
    def __init__(self, df: DataFrame, ref: CubeRef, bands: list[str] | tuple[str, ...], plan: dict[str, Any] | None = None, reduced: frozenset[str] = frozenset()):
        if len(set(bands)) < len(bands):
            raise ValueError(f"band names repeat: {', '.join(bands)}")
        if bad := set(bands) & set(KEYS):
            raise ValueError(f"reserved band names: {', '.join(sorted(bad))}")
        self.df, self.ref, self.bands = df, ref, tuple(bands)
        self.plan = plan
        self.reduced = reduced  # "time" or "space" once an axis was reduced
        #: makes a source's cube anew for a cropped reference and its first cell's indices (it, iy, ix)
        self.remake: Callable[[CubeRef, tuple[int, int, int]], Cube] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def band(self, name: str) -> Column:
        if name not in self.bands:
            raise ValueError(f"there is no band {name!r}; there are {', '.join(self.bands)}")
        return F.col(f"`{name}`")

    def band_columns(self, bands: tuple[str, ...] | list[str] | None = None) -> list[Column]:
        return [self.band(b) for b in (self.bands if bands is None else bands)]

    def metadata(self, band: str) -> dict[str, Any]:
        """Offset, scale, unit and the like, as recorded on the column."""
        return dict(self.df.schema[band].metadata)

    def derive(self, df: DataFrame, *, ref: CubeRef | None = None, bands: list[str] | tuple[str, ...] | None = None, plan: dict[str, Any] | None = None, reduced: frozenset[str] | None = None) -> Cube:
        if plan is not None:
            plan = None if self.plan is None else {**plan, "in_cube": self.plan}
        return Cube(df, ref or self.ref, self.bands if bands is None else bands, plan, self.reduced if reduced is None else reduced)

    def derive_plan(self, source: Cube, plan: dict[str, Any]) -> Cube:
        """This cube with a plan that reads ``source``."""
        self.plan = None if source.plan is None else {**plan, "in_cube": source.plan}
        return self

    # -- structure -----------------------------------------------------------
    def select_bands(self, bands: list[str] | list[int]) -> Cube:
        from .operators.structure import select_bands

        return select_bands(self, bands)

    def rename_bands(self, names: dict[str, str]) -> Cube:
        from .operators.structure import rename_bands

        return rename_bands(self, names)

    def crop(self, ix: tuple[int, int] | None = None, iy: tuple[int, int] | None = None, it: tuple[int, int] | None = None) -> Cube:
        from .operators.structure import crop

        return crop(self, ix, iy, it)

    def crop_extent(self, left: float, right: float, bottom: float, top: float, t0: str, t1: str, snap: str = "near") -> Cube:
        from .operators.structure import crop_extent

        return crop_extent(self, left, right, bottom, top, t0, t1, snap)

    def select_time(self, times: list[str]) -> Cube:
        from .operators.structure import select_time

        return select_time(self, times)

    def slice_time(self, t: int | str) -> Cube:
        from .operators.structure import slice_time

        return slice_time(self, t)

    def slice_space(self, ix: int | None = None, iy: int | None = None, *, x: float | None = None, y: float | None = None) -> Cube:
        from .operators.structure import slice_space

        return slice_space(self, ix, iy, x, y)

    # -- cells ---------------------------------------------------------------
    def apply_pixel(self, expressions: list[str] | str, names: list[str] | None = None, keep_bands: bool = False) -> Cube:
        from .operators.pixel import apply_pixel

        return apply_pixel(self, expressions, names, keep_bands)

    def filter_pixel(self, predicate: str) -> Cube:
        from .operators.pixel import filter_pixel

        return filter_pixel(self, predicate)

    def filter_geom(self, wkt: str, srs: str | None = None) -> Cube:
        from .operators.geometry import filter_geom

        return filter_geom(self, wkt, srs)

    def mask(self, band: str, mask: Any) -> Cube:
        from .operators.pixel import apply_mask

        return apply_mask(self, band, mask)

    # -- groups --------------------------------------------------------------
    def reduce_time(self, reducers: list[tuple[str, str]]) -> Cube:
        from .operators.reduction import reduce_time

        return reduce_time(self, reducers)

    def reduce_space(self, reducers: list[tuple[str, str]]) -> Cube:
        from .operators.reduction import reduce_space

        return reduce_space(self, reducers)

    def aggregate_time(self, dt: str | None = None, func: str = "mean", *, fact: int | None = None) -> Cube:
        from .operators.reduction import aggregate_time

        return aggregate_time(self, dt, func, fact)

    def aggregate_space(self, dx: float | None = None, dy: float | None = None, func: str = "mean", *, fact: int | None = None) -> Cube:
        from .operators.reduction import aggregate_space

        return aggregate_space(self, dx, dy, func, fact)

    # -- series --------------------------------------------------------------
    def window_time(self, reducers: list[tuple[str, str]] | None = None, kernel: list[float] | None = None, left: int = 1, right: int = 1) -> Cube:
        from .operators.series import window_time

        return window_time(self, reducers, kernel, left, right)

    def fill_time(self, method: str = "near") -> Cube:
        from .operators.series import fill_time

        return fill_time(self, method)

    def densify(self) -> Cube:
        from .operators.series import densify

        return densify(self)

    # -- user functions --------------------------------------------------------
    def map_chunks(self, fn: Callable, bands: list[str], chunk_size: tuple[int, int, int] = (16, 256, 256)) -> Cube:
        from .operators.udf import map_chunks

        return map_chunks(self, fn, bands, chunk_size)

    def udf_pixel(self, fn: Callable, names: list[str], keep_bands: bool = False) -> Cube:
        from .operators.udf import udf_pixel

        return udf_pixel(self, fn, names, keep_bands)

    def udf_time(self, fn: Callable, names: list[str], keep_bands: bool = False) -> Cube:
        from .operators.udf import udf_time

        return udf_time(self, fn, names, keep_bands)

    def udf_reduce_time(self, fn: Callable, names: list[str]) -> Cube:
        from .operators.udf import udf_reduce_time

        return udf_reduce_time(self, fn, names)

    def udf_reduce_space(self, fn: Callable, names: list[str]) -> Cube:
        from .operators.udf import udf_reduce_space

        return udf_reduce_space(self, fn, names)

    def stream(self, command: str, chunk_size: tuple[int, int, int] = (16, 256, 256)) -> Cube:
        from .operators.external import stream

        return stream(self, command, chunk_size)

    # -- vector ----------------------------------------------------------------
    def query_points(self, points: DataFrame, srs: str | None = None) -> DataFrame:
        from .operators.vector import query_points

        return query_points(self, points, srs)

    def query_timeseries(self, points: DataFrame, srs: str | None = None) -> DataFrame:
        from .operators.vector import query_timeseries

        return query_timeseries(self, points, srs)

    def extract(self, features: DataFrame, time_column: str | None = None, srs: str | None = None) -> DataFrame:
        from .operators.vector import extract

        return extract(self, features, time_column, srs)

    def zonal_statistics(self, features: DataFrame, aggregates: list[tuple[str, str]], srs: str | None = None) -> DataFrame:
        from .operators.vector import zonal_statistics

        return zonal_statistics(self, features, aggregates, srs)

    # -- output ----------------------------------------------------------------
    def with_coordinates(self) -> DataFrame:
        """Cells with their centre and the start of their slice."""
        r = self.ref
        return self.df.select(*KEYS, r.time.start_column(F.col("it")).alias("t"), (r.left + (F.col("ix") + 0.5) * r.dx).alias("x"), (r.top - (F.col("iy") + 0.5) * r.dy).alias("y"), *self.band_columns())

    def to_array(self):
        """A dense array (band, t, y, x) on the driver; for cubes of a known small size."""
        import numpy as np

        out = np.full((len(self.bands), self.ref.nt, self.ref.ny, self.ref.nx), np.nan)
        rows = self.df.select(*KEYS, *self.band_columns()).toPandas()
        at = [rows[k].to_numpy() for k in KEYS]
        for b, name in enumerate(self.bands):
            out[b][tuple(at)] = rows[name].to_numpy(dtype=float)
        return out

    def to_json(self) -> dict[str, Any]:
        if self.plan is None:
            raise ValueError("this cube was not made from parts that a plan can name")
        return self.plan

    @staticmethod
    def from_json(spark: SparkSession, plan: dict[str, Any] | str, **sources: Any) -> Cube:
        from .plans.factory import from_json

        return from_json(spark, plan, **sources)


def cells(df: DataFrame, ref: CubeRef, bands: list[str], plan: dict[str, Any] | None = None) -> Cube:
    """A cube over a frame that has unique cells already; bands become NULL-cleaned DOUBLE, cells outside go."""
    inside = F.col("ix").between(0, ref.nx - 1) & F.col("iy").between(0, ref.ny - 1) & F.col("it").between(0, ref.nt - 1)
    kept = df.where(inside).select(*[F.col(k).cast("int").alias(k) for k in KEYS], *[clean(F.col(f"`{b}`")).alias(b, metadata=df.schema[b].metadata) for b in bands])
    return Cube(kept, ref, bands, plan)


def regular(cube: Cube, what: str) -> RegularTime:
    if not isinstance(cube.ref.time, RegularTime):
        raise ValueError(f"{what} needs regular time")
    return cube.ref.time
