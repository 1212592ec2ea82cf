"""Geometries as well-known text, and the cells they cover.

A polygon covers the cells whose centre it holds (even-odd rule); its cells are found
line by line as runs ``(iy, first ix, last ix)``, so large areas stay small until they
are joined with cells. Points cover their cell; lines the cells they step through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..crs import transform_point
from ..cube import KEYS, Cube
from ..ref import CubeRef

Ring = list[tuple[float, float]]
WORD = re.compile(r"\s*([A-Za-z]+|[(),]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
RUNS = "fid long, iy int, first int, last int"
#: Runs up to this number are broadcast (some MB); beyond, they are joined by shuffling.
BROADCAST_RUNS = 100_000


class Geometry:
    """``kind`` is point, line or polygon; ``parts`` are points, lines, or polygons as lists of rings."""

    def __init__(self, kind: str, parts: list):
        self.kind, self.parts = kind, parts

    def points(self) -> Iterator[tuple[float, float]]:
        for part in self.parts:
            if self.kind == "point":
                yield part
            elif self.kind == "line":
                yield from part
            else:
                for ring in part:
                    yield from ring

    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*self.points(), strict=True)
        return min(xs), max(xs), min(ys), max(ys)

    def transform(self, source: str | None, target: str | None) -> Geometry:
        def move(p):
            return transform_point(*p, source, target)

        if self.kind == "point":
            return Geometry(self.kind, [move(p) for p in self.parts])
        if self.kind == "line":
            return Geometry(self.kind, [[move(p) for p in line] for line in self.parts])
        return Geometry(self.kind, [[[move(p) for p in ring] for ring in polygon] for polygon in self.parts])


def parse_wkt(text: str) -> Geometry:
    """POINT, LINESTRING and POLYGON and their MULTI forms; Z and M values are left out."""
    tokens, at = [], 0
    stripped = text.strip().rstrip(";")
    while at < len(stripped):
        m = WORD.match(stripped, at)
        if not m:
            raise ValueError(f"not well-known text: {text[:80]!r}")
        tokens.append(m[1])
        at = m.end()
    words = []
    while tokens and tokens[0].isalpha():
        words.append(tokens.pop(0).upper())
    kind = words[0] if words else ""
    if "EMPTY" in words or not tokens:
        raise ValueError("the geometry is empty")
    place = 0

    def read() -> list:
        """A bracket as a list of brackets or of points."""
        nonlocal place
        if tokens[place] != "(":
            raise ValueError(f"not well-known text: {text[:80]!r}")
        place += 1
        out, point = [], []
        while place < len(tokens):
            token = tokens[place]
            if token == "(":
                out.append(read())
                continue
            place += 1
            if token in ",)":
                if point:
                    out.append((point[0], point[1]))
                    point = []
                if token == ")":
                    return out
            else:
                point.append(float(token))
        raise ValueError(f"a bracket is open: {text[:80]!r}")

    body = read()
    if place != len(tokens):
        raise ValueError(f"not well-known text: {text[:80]!r}")
    if kind == "POINT":
        return Geometry("point", body)
    if kind == "MULTIPOINT":
        return Geometry("point", [p[0] if isinstance(p, list) else p for p in body])
    if kind == "LINESTRING":
        return Geometry("line", [body])
    if kind == "MULTILINESTRING":
        return Geometry("line", body)
    if kind == "POLYGON":
        return Geometry("polygon", [body])
    if kind == "MULTIPOLYGON":
        return Geometry("polygon", body)
    raise ValueError(f"unsupported geometry {kind!r}")


def _polygon_runs(polygons: list, r: CubeRef) -> Iterator[tuple[int, int, int]]:
    edges = []
    for polygon in polygons:
        for ring in polygon:
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
                if y0 != y1:
                    edges.append((y0, y1, x0, x1) if y0 < y1 else (y1, y0, x1, x0))
    if not edges:
        return
    first = max(0, math.floor((r.top - max(e[1] for e in edges)) / r.dy - 0.5))
    last = min(r.ny - 1, math.ceil((r.top - min(e[0] for e in edges)) / r.dy - 0.5))
    edges.sort(key=lambda e: -e[1])
    begin, live = 0, []
    for iy in range(first, last + 1):
        y = r.top - (iy + 0.5) * r.dy
        while begin < len(edges) and edges[begin][1] > y:
            live.append(edges[begin])
            begin += 1
        live = [e for e in live if e[0] <= y]
        xs = sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for y0, y1, x0, x1 in live if y0 <= y < y1)
        for a, b in zip(xs[::2], xs[1::2], strict=False):
            low = max(0, math.ceil((a - r.left) / r.dx - 0.5))
            high = min(r.nx - 1, math.ceil((b - r.left) / r.dx - 0.5) - 1)
            if low <= high:
                yield iy, low, high


def _line_cells(line: Ring, r: CubeRef) -> Iterator[tuple[int, int, int]]:
    for (x0, y0), (x1, y1) in zip(line[:-1], line[1:], strict=True):
        steps = max(1, math.ceil(2 * max(abs(x1 - x0) / r.dx, abs(y1 - y0) / r.dy)))
        for k in range(steps + 1):
            yield from _point_cell((x0 + (x1 - x0) * k / steps, y0 + (y1 - y0) * k / steps), r)


def _point_cell(p: tuple[float, float], r: CubeRef) -> Iterator[tuple[int, int, int]]:
    ix, iy = r.ix_at(p[0]), r.iy_at(p[1])
    if 0 <= ix < r.nx and 0 <= iy < r.ny:
        yield iy, ix, ix


def runs(geometry: Geometry, r: CubeRef) -> Iterator[tuple[int, int, int]]:
    """Disjoint runs of covered cells within the grid."""
    if geometry.kind == "polygon":
        yield from _polygon_runs(geometry.parts, r)
    else:
        parts = (_point_cell(p, r) for p in geometry.parts) if geometry.kind == "point" else (_line_cells(line, r) for line in geometry.parts)
        yield from dict.fromkeys(x for part in parts for x in part)


def feature_runs(features: DataFrame, r: CubeRef, srs: str | None = None, polygons_only: bool = False) -> DataFrame:
    """Runs of every feature (``fid``, ``wkt``); a map over the features."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["fid", "iy", "first", "last"])

        held: list[tuple[int, int, int, int]] = []
        for batch in rows:
            for row in batch.to_pylist():
                if row["wkt"] is None:
                    continue
                geometry = parse_wkt(row["wkt"]).transform(srs, r.srs)
                if polygons_only and geometry.kind != "polygon":
                    raise ValueError("only polygons are supported here")
                for run in runs(geometry, r):
                    held.append((row["fid"], *run))
                    if len(held) >= 50_000:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    return features.select(F.col("fid").cast("long").alias("fid"), "wkt").mapInArrow(batches, RUNS)


def feature_cells(features: DataFrame, r: CubeRef, srs: str | None = None, polygons_only: bool = False) -> DataFrame:
    """``fid, iy, ix`` of every covered cell."""
    found = feature_runs(features, r, srs, polygons_only)
    return found.select("fid", "iy", F.explode(F.sequence("first", "last")).alias("ix"))


def filter_geom(cube: Cube, wkt: str, srs: str | None) -> Cube:
    """The cells whose centre lies in a (multi)polygon that lies within the cube."""
    r = cube.ref
    geometry = parse_wkt(wkt).transform(srs, r.srs)
    if geometry.kind != "polygon":
        raise ValueError("filter_geom needs a polygon")
    left, right, bottom, top = geometry.bounds()
    slack = 1e-9 * max(1.0, abs(r.right), abs(r.top))
    if left < r.left - slack or right > r.right + slack or bottom < r.bottom - slack or top > r.top + slack:
        raise ValueError("the polygon must lie within the cube")
    found = list(runs(geometry, r))
    box = cube.df.where(F.col("ix").between(max(0, r.ix_at(left)), r.ix_at(right)) & F.col("iy").between(max(0, r.iy_at(top)), r.iy_at(bottom)))
    table = cube.spark.createDataFrame(found, "_iy int, _first int, _last int")
    if len(found) <= BROADCAST_RUNS:
        table = F.broadcast(table)
    kept = box.join(table, (F.col("iy") == F.col("_iy")) & F.col("ix").between(F.col("_first"), F.col("_last")), "left_semi")
    return cube.derive(kept.select(*KEYS, *cube.band_columns()), plan={"cube_type": "filter_geom", "wkt": wkt, "srs": srs or r.srs})
