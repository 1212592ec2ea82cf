"""Bands, cropping and slicing: projections, filters and index shifts only."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..cube import KEYS, Cube
from ..timeaxis import LabeledTime, RegularTime, Time, parse_time


def select_bands(cube: Cube, bands: list[str] | list[int]) -> Cube:
    """The named or numbered (from 0) bands in the order asked for."""
    names = [cube.bands[b] if isinstance(b, int) else b for b in bands]
    if not names:
        raise ValueError("no band is selected")
    return cube.derive(cube.df.select(*KEYS, *cube.band_columns(names)), bands=names, plan={"cube_type": "select_bands", "bands": names})


def rename_bands(cube: Cube, names: dict[str, str]) -> Cube:
    """Names that the cube doesn't have are ignored."""
    used = {old: new for old, new in names.items() if old in cube.bands}
    return cube.derive(cube.df.withColumnsRenamed(used), bands=[used.get(b, b) for b in cube.bands], plan={"cube_type": "rename_bands", "band_names": dict(names)})


def crop(cube: Cube, ix: tuple[int, int] | None, iy: tuple[int, int] | None, it: tuple[int, int] | None) -> Cube:
    """Index ranges with both ends; ranges that reach beyond the cube enlarge it with missing cells."""
    r = cube.ref
    ranges = []
    for name, given, n in (("ix", ix, r.nx), ("iy", iy, r.ny), ("it", it, r.nt)):
        low, high = sorted(given) if given is not None else (0, n - 1)
        if high < 0 or low >= n:
            raise ValueError(f"{name} {low}..{high} lies outside of 0..{n - 1}")
        ranges.append((int(low), int(high)))
    cx, cy, ct = ranges
    kept = cube.df.where(F.col("ix").between(*cx) & F.col("iy").between(*cy) & F.col("it").between(*ct))
    shifted = kept.select((F.col("it") - ct[0]).alias("it"), (F.col("iy") - cy[0]).alias("iy"), (F.col("ix") - cx[0]).alias("ix"), *cube.band_columns())
    time = r.time if ct == (0, r.nt - 1) else r.time.slice_of(*ct)
    plan = {"cube_type": "crop", "ix_min": cx[0], "ix_max": cx[1], "iy_min": cy[0], "iy_max": cy[1], "it_min": ct[0], "it_max": ct[1]}
    ref = r.crop_space(cx, cy).with_(time=time)
    if cube.remake and all(0 <= low and high < n for (low, high), n in zip(ranges, (r.nx, r.ny, r.nt), strict=True)):
        return cube.remake(ref, (ct[0], cy[0], cx[0])).derive_plan(cube, plan)
    return cube.derive(shifted, ref=ref, plan=plan)


def _half_away(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


SNAP = {"near": (_half_away, _half_away), "in": (math.ceil, math.floor), "out": (math.floor, math.ceil)}


def crop_extent(cube: Cube, left: float, right: float, bottom: float, top: float, t0: str, t1: str, snap: str) -> Cube:
    """By coordinates; ``snap`` moves bounds to the nearest cell edges, inwards or outwards."""
    if snap not in SNAP:
        raise ValueError("snap must be one of near, in and out")
    low, high = SNAP[snap]
    r, a, b = cube.ref, parse_time(t0), parse_time(t1)
    if {a.unit, b.unit} != {r.time.unit}:
        raise ValueError("the times must have the unit of the cube")
    noise = 1e-9  # of a cell: differences of bounds aren't exact

    def cut(first: float, last: float) -> tuple[int, int]:
        near = [round(v) if abs(v - round(v)) < noise else v for v in (first, last)]
        return int(low(near[0])), int(high(near[1]))

    if isinstance(r.time, RegularTime):
        start = Time(r.time.t0.value, r.time.unit)
        it = cut((a - start).count / r.time.dt.count, (b - start).count / r.time.dt.count)
    else:
        labels = [t.value for t in r.time.times]
        if not (labels[0] <= a.value <= labels[-1] and labels[0] <= b.value <= labels[-1]):
            raise ValueError("the times reach beyond the labels")

        def place(t: Time) -> float:
            for i, v in enumerate(labels):
                if v == t.value:
                    return i
                if v > t.value:
                    return i - 1 + (t.value - labels[i - 1]) / (v - labels[i - 1])
            return len(labels) - 1

        it = cut(place(a), place(b))
    ix = cut((left - r.left) / r.dx, (right - r.left) / r.dx - 1)
    iy = cut((r.top - top) / r.dy, (r.top - bottom) / r.dy - 1)
    return crop(cube, ix, iy, it)


def select_time(cube: Cube, times: list[str]) -> Cube:
    """The slices that hold the given times, labelled by them; times outside the cube are left out."""
    r = cube.ref
    chosen: dict = {}
    for text in times:
        t = parse_time(text).truncate(r.time.unit)
        if isinstance(r.time, RegularTime):
            at = r.time.index(t)
            inside = 0 <= at < r.nt
        else:
            inside = t.value in {x.value for x in r.time.times}
            at = r.time.index(t) if inside else -1
        if inside and t not in chosen:
            chosen[t] = at
    if not chosen:
        raise ValueError("none of the times lies within the cube")
    labels = sorted(chosen, key=lambda t: t.value)
    # a slice may be asked for by several times; each label gets its own copy
    wanted: dict[int, list[int]] = {}
    for place, t in enumerate(labels):
        wanted.setdefault(chosen[t], []).append(place)
    places = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    kept = cube.df.where(F.col("it").isin(*wanted))
    moved = kept.select(F.explode(F.element_at(places, F.col("it"))).alias("it"), "iy", "ix", *cube.band_columns())
    axis = LabeledTime(tuple(labels), r.time.dt)
    return cube.derive(moved, ref=r.with_(time=axis), plan={"cube_type": "select_time", "t": [str(t) for t in labels]})


def slice_time(cube: Cube, t: int | str) -> Cube:
    """One slice, by index or by a time that lies in it."""
    r = cube.ref
    at = t if isinstance(t, int) else r.time.index(parse_time(t).truncate(r.time.unit))
    if not 0 <= at < r.nt:
        raise ValueError(f"slice {t} lies outside of the cube")
    if cube.remake:
        return crop(cube, None, None, (at, at)).derive_plan(cube, {"cube_type": "slice_time", "t": at})
    one = cube.df.where(F.col("it") == at).select(F.lit(0).alias("it"), "iy", "ix", *cube.band_columns())
    return cube.derive(one, ref=r.with_(time=r.time.slice_of(at, at)), plan={"cube_type": "slice_time", "t": at})


def slice_space(cube: Cube, ix: int | None, iy: int | None, x: float | None, y: float | None) -> Cube:
    """One pixel's series, by indices or coordinates."""
    r = cube.ref
    if ix is None or iy is None:
        if x is None or y is None:
            raise ValueError("give ix and iy, or x and y")
        ix, iy = r.ix_at(x), r.iy_at(y)
    if not (0 <= ix < r.nx and 0 <= iy < r.ny):
        raise ValueError(f"pixel {ix}, {iy} lies outside of the cube")
    if cube.remake:
        return crop(cube, (ix, ix), (iy, iy), None).derive_plan(cube, {"cube_type": "slice_space", "ix": ix, "iy": iy})
    one = cube.df.where((F.col("ix") == ix) & (F.col("iy") == iy)).select("it", F.lit(0).alias("iy"), F.lit(0).alias("ix"), *cube.band_columns())
    return cube.derive(one, ref=r.crop_space((ix, ix), (iy, iy)), plan={"cube_type": "slice_space", "ix": ix, "iy": iy})


