"""JSON plans to cubes.

A plan is a tree of objects with a ``cube_type``; ``in_cube`` or ``in_cubes`` hold the
inputs. New types can be registered.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube
from ..operators import external
from ..operators.join import join_bands
from ..operators.pixel import mask_from_json
from ..ref import CubeRef, CubeView
from ..sources import basic, geotiff, netcdf
from ..sources.catalog import ImageCollection
from ..timeaxis import LabeledTime, parse_time

Maker = Callable[["Context", dict[str, Any]], Cube | DataFrame]
_types: dict[str, Maker] = {}


class Context:
    """The session, and frames and collections that plans name instead of files."""

    def __init__(self, spark: SparkSession, sources: dict[str, Any]):
        self.spark, self.sources = spark, sources

    def input(self, plan: dict[str, Any]) -> Cube:
        return build(self, plan["in_cube"])


def register(name: str) -> Callable[[Maker], Maker]:
    def keep(maker: Maker) -> Maker:
        _types[name] = maker
        return maker

    return keep


def build(context: Context, plan: dict[str, Any]) -> Any:
    kind = plan.get("cube_type")
    if kind not in _types:
        raise ValueError(f"unknown cube type {kind!r}")
    return _types[kind](context, plan)


def from_json(spark: SparkSession, plan: dict[str, Any] | str, **sources: Any) -> Any:
    """A cube (for ``extract`` a frame) from a plan: an object, JSON text, or a file's path."""
    if isinstance(plan, str):
        if not plan.lstrip().startswith("{"):
            with open(plan, encoding="utf-8") as file:
                plan = file.read()
        plan = json.loads(plan)
    return build(Context(spark, sources), plan)


def _view(value: Any) -> CubeView:
    if isinstance(value, str) and os.path.isfile(value):
        with open(value, encoding="utf-8") as file:
            value = json.load(file)
    return CubeView.from_json(value)


def _pairs(value: list) -> list[tuple[str, str]]:
    return [(f, b) for f, b in value]


@register("dummy")
def _dummy(c: Context, p: dict) -> Cube:
    return basic.dummy(c.spark, _view(p["view"]), p.get("nbands", 1), p.get("fill", 1.0))


@register("empty")
def _empty(c: Context, p: dict) -> Cube:
    return basic.empty(c.spark, _view(p["view"]), p.get("nbands", 1))


@register("ncdf")
def _ncdf(c: Context, p: dict) -> Cube:
    return netcdf.from_netcdf(c.spark, p["file"], p.get("auto_unpack", True), p.get("band_selection"))


@register("simple_cube")
def _simple(c: Context, p: dict) -> Cube:
    """Aligned GeoTIFF files, one time for each."""
    files, times = p["files"], p["datetime"]
    first = geotiff.read(_bytes(c.spark, files[0]))
    count, height, width = first.values.shape
    dx, dy = p.get("dx") or first.dx, p.get("dy") or first.dy
    given = p.get("band_names") or p.get("bands")
    per_file = p.get("bands")
    if per_file:  # one band a file
        names = list(dict.fromkeys(per_file))
    else:
        names = list(given) if given else [f"x{k + 1}" for k in range(count)]
    ref = CubeRef(first.left, first.left + width * dx, first.top - height * dy, first.top, width, height, first.srs, LabeledTime((parse_time(times[0]),)))
    frames = []
    pixels = _tiff_cells(c.spark, files)
    for k, (path, t) in enumerate(zip(files, times, strict=True)):
        own = pixels.where(F.col("file") == k)
        if per_file:
            columns = [F.col("values")[0].alias(per_file[k])]
        else:
            columns = [F.col("values")[b].alias(n) for b, n in enumerate(names)]
        frames.append((t, own.select("iy", "ix", *columns)))
    out = basic.from_frames(frames, ref, names)
    return Cube(out.df, out.ref, out.bands, {k: v for k, v in p.items()})


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _tiff_cells(spark: SparkSession, files: list[str]) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    number = {p.removeprefix("file:").removeprefix("//"): k for k, p in enumerate(files)}

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                t = geotiff.read(content.as_py())
                k = number["/" + path.removeprefix("file:").lstrip("/")]
                bands, height, width = t.values.shape
                for row in range(0, height, 256):
                    block = t.values[:, row : row + 256].astype(float).reshape(bands, -1)
                    n = block.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, k, np.int32)), pa.array((row + np.arange(n) // width).astype(np.int32)), pa.array((np.arange(n) % width).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(np.ascontiguousarray(block.T).ravel()))],
                        names=["file", "iy", "ix", "values"],
                    )

    return spark.read.format("binaryFile").load(sorted(set(files))).select("path", "content").mapInArrow(run, "file int, iy int, ix int, values array<double>")


@register("image_collection")
def _collection(c: Context, p: dict) -> Cube:
    source = c.sources.get(p["file"])
    collection = source if isinstance(source, ImageCollection) else ImageCollection.read(c.spark, p["file"])
    mask = mask_from_json(p["mask"]) if p.get("mask") else None
    view = _view(p["view"]) if p.get("view") else None
    cube = collection.cube(view, p.get("band_selection"), c.sources.get("pixels"), mask, p.get("mask_band"))
    return Cube(cube.df, cube.ref, cube.bands, dict(p))


@register("select_bands")
def _select(c: Context, p: dict) -> Cube:
    return c.input(p).select_bands(p["bands"])


@register("rename_bands")
def _rename(c: Context, p: dict) -> Cube:
    return c.input(p).rename_bands(p["band_names"])


@register("apply_pixel")
def _apply(c: Context, p: dict) -> Cube:
    return c.input(p).apply_pixel(p["expr"], p.get("band_names"), p.get("keep_bands", False))


@register("filter_pixel")
def _filter(c: Context, p: dict) -> Cube:
    return c.input(p).filter_pixel(p["predicate"])


@register("filter_geom")
def _filter_geom(c: Context, p: dict) -> Cube:
    return c.input(p).filter_geom(p["wkt"], p.get("srs"))


@register("reduce_time")
def _reduce_time(c: Context, p: dict) -> Cube:
    return c.input(p).reduce_time(_pairs(p["reducer_bands"]))


@register("reduce_space")
def _reduce_space(c: Context, p: dict) -> Cube:
    return c.input(p).reduce_space(_pairs(p["reducer_bands"]))


@register("aggregate_time")
def _aggregate_time(c: Context, p: dict) -> Cube:
    return c.input(p).aggregate_time(p.get("dt"), p.get("func", "mean"), fact=p.get("fact"))


@register("aggregate_space")
def _aggregate_space(c: Context, p: dict) -> Cube:
    return c.input(p).aggregate_space(p.get("dx"), p.get("dy"), p.get("func", "mean"), fact=p.get("fact"))


@register("window_time")
def _window(c: Context, p: dict) -> Cube:
    reducers = _pairs(p["reducer_bands"]) if p.get("reducer_bands") else None
    return c.input(p).window_time(reducers, p.get("kernel"), p["win_size_l"], p["win_size_r"])


@register("fill_time")
def _fill(c: Context, p: dict) -> Cube:
    return c.input(p).fill_time(p.get("method", "near"))


@register("join_bands")
def _join(c: Context, p: dict) -> Cube:
    return join_bands([build(c, x) for x in p["in_cubes"]], p.get("prefixes"))


@register("crop")
def _crop(c: Context, p: dict) -> Cube:
    return c.input(p).crop((p["ix_min"], p["ix_max"]), (p["iy_min"], p["iy_max"]), (p["it_min"], p["it_max"]))


@register("select_time")
def _select_time(c: Context, p: dict) -> Cube:
    return c.input(p).select_time(p["t"])


@register("slice_time")
def _slice_time(c: Context, p: dict) -> Cube:
    return c.input(p).slice_time(p["t"])


@register("slice_space")
def _slice_space(c: Context, p: dict) -> Cube:
    return c.input(p).slice_space(p["ix"], p["iy"])


@register("extract")
def _extract(c: Context, p: dict) -> DataFrame:
    name = p["ogr_dataset"]
    features = c.sources[name] if name in c.sources else c.spark.read.parquet(name)
    return c.input(p).extract(features, p.get("time_column") or None, p.get("srs"))


@register("stream")
def _stream(c: Context, p: dict) -> Cube:
    return external.stream(c.input(p), p["command"], tuple(p.get("chunk_size", (16, 256, 256))))


@register("stream_apply_pixel")
@register("stream_apply_pixel_cube")
def _stream_pixel(c: Context, p: dict) -> Cube:
    return external.stream_apply_pixel(c.input(p), p["cmd"], p["nbands"], p.get("names"), p.get("keep_bands", False))


@register("stream_apply_time")
@register("stream_apply_time_cube")
def _stream_time(c: Context, p: dict) -> Cube:
    return external.stream_apply_time(c.input(p), p["cmd"], p["nbands"], p.get("names"), p.get("keep_bands", False))


@register("stream_reduce_time")
def _stream_reduce_time(c: Context, p: dict) -> Cube:
    return external.stream_reduce_time(c.input(p), p["cmd"], p["nbands"], p.get("names"))


@register("stream_reduce_space")
def _stream_reduce_space(c: Context, p: dict) -> Cube:
    return external.stream_reduce_space(c.input(p), p["cmd"], p["nbands"], p.get("names"))
