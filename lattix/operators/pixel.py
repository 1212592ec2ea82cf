"""Operators on single cells: expressions, predicates and masks. No shuffle."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import KEYS, Cube
from ..functions.expressions import compile_expression, compile_predicate, names_in, parse_expression
from ..timeaxis import RegularTime, seconds_since

EPOCH = datetime(1970, 1, 1)


def _extras(cube: Cube) -> Mapping[str, Column]:
    """Indices, edges and times of a cell as variables."""
    r = cube.ref
    ix, iy, it = (F.col(k) for k in ("ix", "iy", "it"))
    time = r.time
    following = time.start_column(it + 1) if isinstance(time, RegularTime) else time.start_column(it + F.lit(1))
    return {
        "ix": ix.cast("double"),
        "iy": iy.cast("double"),
        "it": it.cast("double"),
        "left": r.left + ix * r.dx,
        "right": r.left + (ix + 1) * r.dx,
        "top": r.top - iy * r.dy,
        "bottom": r.top - (iy + 1) * r.dy,
        "t0": seconds_since(time.start_column(it), EPOCH).cast("double"),
        "t1": seconds_since(following, EPOCH).cast("double"),
    }


def _bands(cube: Cube) -> dict[str, Column]:
    names = {b.lower(): cube.band(b) for b in cube.bands}
    if len(names) < len(cube.bands):
        raise ValueError("band names differ in case only")
    return names


def apply_pixel(cube: Cube, expressions: list[str] | str, names: list[str] | None, keep_bands: bool) -> Cube:
    """New bands from expressions over bands, ``ix iy it left right top bottom t0 t1``; names default to x1, x2, ..."""
    expressions = [expressions] if isinstance(expressions, str) else list(expressions)
    names = list(names) if names else [f"x{k + 1}" for k in range(len(expressions))]
    if len(names) != len(expressions):
        raise ValueError("there must be one name for each expression")
    bands = _bands(cube)
    used = set().union(*(names_in(parse_expression(e)) for e in expressions))
    variables = {**(_extras(cube) if used - set(bands) else {}), **bands}
    new = [compile_expression(e, variables).cast("double").alias(n) for e, n in zip(expressions, names, strict=True)]
    kept = cube.bands if keep_bands else ()
    out = cube.df.select(*KEYS, *cube.band_columns(kept), *new)
    return cube.derive(out, bands=[*kept, *names], plan={"cube_type": "apply_pixel", "expr": expressions, "band_names": names, "keep_bands": keep_bands})


def filter_pixel(cube: Cube, predicate: str) -> Cube:
    """Cells where the predicate is not zero; the others stay as rows whose bands are missing."""
    keep = compile_predicate(predicate, _bands(cube))
    out = cube.df.select(*KEYS, *[F.when(keep, cube.band(b)).alias(b) for b in cube.bands])
    return cube.derive(out, plan={"cube_type": "filter_pixel", "predicate": predicate})


@dataclass(frozen=True)
class ValueMask:
    """Masks cells whose mask value is listed (or, inverted, is not)."""

    values: tuple[float, ...]
    invert: bool = False
    bits: tuple[int, ...] = ()

    def hits(self, value: Column) -> Column:
        value = _bits(value, self.bits)
        hit = value.isin(*[float(v) for v in self.values])
        return ~hit if self.invert else hit


@dataclass(frozen=True)
class RangeMask:
    """Masks cells whose mask value lies within closed bounds (or, inverted, outside)."""

    low: float
    high: float
    invert: bool = False
    bits: tuple[int, ...] = ()

    def hits(self, value: Column) -> Column:
        hit = _bits(value, self.bits).between(self.low, self.high)
        return ~hit if self.invert else hit


def _bits(value: Column, bits: tuple[int, ...]) -> Column:
    if not bits:
        return value
    return value.cast("long").bitwiseAND(F.lit(sum(1 << b for b in set(bits)))).cast("double")


def mask_condition(value: Column, mask: ValueMask | RangeMask) -> Column:
    """Whether a cell is masked; a missing mask value masks nothing."""
    return F.coalesce(mask.hits(value), F.lit(False))


def apply_mask(cube: Cube, band: str, mask: ValueMask | RangeMask) -> Cube:
    masked = mask_condition(cube.band(band), mask)
    return cube.derive(cube.df.select(*KEYS, *[F.when(~masked, cube.band(b)).alias(b) for b in cube.bands]))


def mask_from_json(value: dict) -> ValueMask | RangeMask:
    bits = tuple(value.get("bits") or ())
    if value["mask_type"] == "value_mask":
        return ValueMask(tuple(value["values"]), bool(value.get("invert", False)), bits)
    if value["mask_type"] == "range_mask":
        return RangeMask(value["min"], value["max"], bool(value.get("invert", False)), bits)
    raise ValueError(f"unknown mask type {value['mask_type']!r}")
