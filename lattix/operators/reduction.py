"""Group-bys over cells: reduction of an axis and aggregation to a coarser grid.

Each is one hash aggregation with partial sums before the shuffle; exact medians and
quantiles keep counts by value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cube import KEYS, Cube, regular
from ..functions.aggregates import AGGREGATES, REDUCERS, aggregate_column, known
from ..ref import CubeRef
from ..timeaxis import Duration, RegularTime, Time


def _spec(cube: Cube, reducers: list[tuple[str, str]], allowed: tuple[str, ...], what: str) -> list[tuple[str, str]]:
    if not reducers:
        raise ValueError(f"{what} needs at least one function and band")
    out = [(known(f, allowed), b) for f, b in reducers]
    for _, b in out:
        cube.band(b)
    return out


def reduce_time(cube: Cube, reducers: list[tuple[str, str]]) -> Cube:
    """One slice from all; bands ``<band>_<function>``.

    A cube whose time was reduced before is returned with the bands asked for.
    ``which_min`` and ``which_max`` give the earliest date of the extreme as digits.
    """
    spec = _spec(cube, reducers, REDUCERS, "reduce_time")
    plan = {"cube_type": "reduce_time", "reducer_bands": [list(x) for x in spec]}
    if "time" in cube.reduced:
        from .structure import select_bands

        return select_bands(cube, list(dict.fromkeys(b for _, b in spec)))
    it = F.col("it")
    grouped = cube.df.groupBy("iy", "ix").agg(*[aggregate_column(f, cube.band(b), "reduce", it).alias(f"{b}_{f}") for f, b in spec])
    columns = [cube.ref.time.number_column(F.col(f"`{b}_{f}`")).alias(f"{b}_{f}") if f.startswith("which") else F.col(f"`{b}_{f}`") for f, b in spec]
    time = cube.ref.time
    if isinstance(time, RegularTime):
        total = (Time(time.t1.value, time.unit) - Time(time.t0.value, time.unit)).count + 1
        time = RegularTime(time.t0, time.t1, Duration(total, time.unit))
    else:
        time = time.slice_of(0, 0)
    return cube.derive(grouped.select(F.lit(0).alias("it"), "iy", "ix", *columns), ref=cube.ref.with_(time=time), bands=[f"{b}_{f}" for f, b in spec], plan=plan, reduced=cube.reduced | {"time"})


def reduce_space(cube: Cube, reducers: list[tuple[str, str]]) -> Cube:
    """One pixel from all; bands ``<band>_<function>``."""
    spec = _spec(cube, reducers, AGGREGATES, "reduce_space")
    plan = {"cube_type": "reduce_space", "reducer_bands": [list(x) for x in spec]}
    if "space" in cube.reduced:
        from .structure import select_bands

        return select_bands(cube, list(dict.fromkeys(b for _, b in spec)))
    grouped = cube.df.groupBy("it").agg(*[aggregate_column(f, cube.band(b), "reduce").alias(f"{b}_{f}") for f, b in spec])
    bands = [f"{b}_{f}" for f, b in spec]
    return cube.derive(grouped.select("it", F.lit(0).alias("iy"), F.lit(0).alias("ix"), *[f"`{b}`" for b in bands]), ref=cube.ref.with_(nx=1, ny=1), bands=bands, plan=plan, reduced=cube.reduced | {"space"})


def aggregate_time(cube: Cube, dt: str | None, func: str, fact: int | None) -> Cube:
    """Coarser slices; a slice goes where its start lies. Bands keep their names."""
    func = known(func, AGGREGATES)
    if (dt is None) == (fact is None):
        raise ValueError("give either dt or fact")
    time = cube.ref.time
    step = regular(cube, "aggregation by a factor").dt * int(fact) if fact is not None else Duration.parse(dt)
    first = Time(time.t0.value, time.unit)
    last = Time(time.t1.value, time.unit)
    coarse = RegularTime.by_duration(first, last, step)
    to = coarse.index_column(time.start_column(F.col("it")))
    grouped = cube.df.select(to.alias("it"), "iy", "ix", *cube.band_columns()).where(F.col("it").between(0, coarse.nt - 1)).groupBy(*KEYS)
    out = grouped.agg(*[aggregate_column(func, cube.band(b)).alias(b) for b in cube.bands])
    return cube.derive(out, ref=cube.ref.with_(time=coarse), plan={"cube_type": "aggregate_time", "dt": str(step), "func": func})


def aggregate_space(cube: Cube, dx: float | None, dy: float | None, func: str, fact: int | None) -> Cube:
    """Coarser pixels; a pixel goes where its centre lies."""
    func = known(func, AGGREGATES)
    r = cube.ref
    if fact is not None:
        dx, dy = r.dx * int(fact), r.dy * int(fact)
    if dx is None or dy is None:
        raise ValueError("give dx and dy, or fact")
    out_ref = CubeRef.create(r.left, r.right, r.bottom, r.top, dx=dx, dy=dy, srs=r.srs, t0=r.time.t0, t1=r.time.t0, nt=1).with_(time=r.time)
    ix = F.floor((r.left - out_ref.left + (F.col("ix") + 0.5) * r.dx) / out_ref.dx).cast("int")
    iy = F.floor((out_ref.top - r.top + (F.col("iy") + 0.5) * r.dy) / out_ref.dy).cast("int")
    grouped = cube.df.select("it", iy.alias("iy"), ix.alias("ix"), *cube.band_columns()).groupBy(*KEYS)
    out = grouped.agg(*[aggregate_column(func, cube.band(b)).alias(b) for b in cube.bands])
    return cube.derive(out, ref=out_ref, plan={"cube_type": "aggregate_space", "dx": dx, "dy": dy, "func": func})
