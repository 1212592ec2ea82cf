"""Joining the bands of cubes on one grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..cube import KEYS, Cube


def join_bands(cubes: list[Cube], prefixes: list[str] | None = None) -> Cube:
    """All bands of two or more cubes with the same grid; a cell that one lacks is missing there.

    Bands become ``<prefix>.<band>``; without prefixes they are X1, X2, ...
    """
    if len(cubes) < 2:
        raise ValueError("join_bands needs at least two cubes")
    prefixes = list(prefixes) if prefixes else [f"X{k + 1}" for k in range(len(cubes))]
    if len(prefixes) != len(cubes):
        raise ValueError("there must be one prefix for each cube")
    if len(set(prefixes)) < len(prefixes):
        raise ValueError("prefixes must differ")
    first = cubes[0].ref
    for c in cubes[1:]:
        if not first.same_space(c.ref) or type(first.time) is not type(c.ref.time) or [t.value for t in first.time.labels()] != [t.value for t in c.ref.time.labels()]:
            raise ValueError("the cubes do not have the same grid")
    frames = [c.df.select(*KEYS, *[c.band(b).alias(f"{p}.{b}") for b in c.bands]) for c, p in zip(cubes, prefixes, strict=True)]
    joined = reduce(lambda a, b: a.join(b, list(KEYS), "full_outer"), frames)
    plans = [c.plan for c in cubes]
    plan = {"cube_type": "join_bands", "in_cubes": plans, "prefixes": prefixes} if all(plans) else None
    bands = [f"{p}.{b}" for c, p in zip(cubes, prefixes, strict=True) for b in c.bands]
    return Cube(joined.select(*KEYS, *[F.col(f"`{b}`") for b in bands]), first, bands, plan)
