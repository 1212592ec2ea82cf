"""Cubes as tables and as files.

Tables are Parquet with one directory a slice, written by all tasks. Image files hold a
slice or a chunk each and are encoded by the task that holds its rows; they are written
as rows of ``path, content`` first and put into place by ``place_files``, through Spark's
file system layer. Formats that are one file hold a whole cube, which must fit the driver.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import KEYS, Cube
from ..operators.udf import chunk_grid
from ..ref import CubeView
from ..sources import geotiff, netcdf
from ..timeaxis import LabeledTime, Time
from .packing import PACKINGS, Packing

FILE_SCHEMA = "path string, content binary"


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One file through Hadoop's file system, wherever the path lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_cube(cube: Cube, path: str, mode: str = "errorifexists", tile: int = 256) -> None:
    """Cells as Parquet by slice and tile row, and a description; ``sources.read_cube`` reads it.

    Filters on ``it`` prune directories, filters on ``iy`` and ``ix`` row groups.
    """
    tiles = cube.df.select(*KEYS, *cube.band_columns(), F.floor(F.col("iy") / tile).cast("int").alias("_tile"))
    tiles.repartition(F.col("it"), F.col("_tile")).sortWithinPartitions(*KEYS).write.mode(mode).partitionBy("it").parquet(f"{path}/cells")
    time = cube.ref.time
    view = CubeView(cube.ref).to_json()
    about = {"view": view, "bands": list(cube.bands), "labels": [str(t) for t in time.labels()] if isinstance(time, LabeledTime) else None}
    put_file(cube.spark, f"{path}/about.json", json.dumps(about).encode())


def place_files(files: DataFrame) -> int:
    """Write rows of ``path, content`` one after another; only one content is on the driver at a time."""
    n = 0
    for r in files.toLocalIterator():
        put_file(files.sparkSession, r["path"], bytes(r["content"]))
        n += 1
    return n


def _label(t: Time) -> str:
    return str(t).replace(":", "")


def _slices(cube: Cube, encode: Callable[[np.ndarray], bytes], name: Callable[[int], str]) -> DataFrame:
    """A file for every slice with rows."""
    bands, ny, nx = list(cube.bands), cube.ref.ny, cube.ref.nx

    def run(f: pd.DataFrame) -> pd.DataFrame:
        block = np.full((len(bands), ny, nx), np.nan)
        at = (f["iy"].to_numpy(), f["ix"].to_numpy())
        for b, band in enumerate(bands):
            block[b][at] = f[band].to_numpy(float, na_value=np.nan)
        return pd.DataFrame({"path": [name(int(f["it"].iloc[0]))], "content": [encode(block)]})

    return cube.df.select(*KEYS, *cube.band_columns()).groupBy("it").applyInPandas(run, FILE_SCHEMA)


def packed_array(values: np.ndarray, packing: Packing | None) -> tuple[np.ndarray, float | None]:
    """A (band, y, x) array in the packing's type, and a no-data value that all bands share."""
    if packing is None:
        return values, None
    out = np.empty(values.shape, PACKINGS[packing.kind][1])
    nodata = None
    for k, v in enumerate(values):
        scale, offset, nodata = packing.of(k, len(values))
        if packing.kind == "float32":
            out[k] = np.where(np.isnan(v), nodata, v)
        else:
            low, high = PACKINGS[packing.kind][2:]
            x = (v - offset) / scale
            rounded = np.copysign(np.floor(np.abs(x) + 0.5), x)
            out[k] = np.where(np.isnan(v), nodata, np.clip(rounded, low, high)).astype(out.dtype)
    return out, nodata


def write_tif_collection(cube: Cube, path: str, prefix: str = "", packing: Packing | None = None, compress: bool = True) -> int:
    """A GeoTIFF for every slice with rows, named by its start; the number of files."""
    r = cube.ref
    labels = [_label(t) for t in r.time.labels()]

    def encode(block: np.ndarray) -> bytes:
        values, nodata = packed_array(block, packing)
        return geotiff.write(geotiff.Raster(values, r.left, r.top, r.dx, r.dy, r.srs, nodata), compress)

    return place_files(_slices(cube, encode, lambda it: f"{path}/{prefix}{labels[it]}.tif"))


def png(image: np.ndarray) -> bytes:
    """An 8-bit image (y, x, channels) with 1 to 4 channels."""
    height, width, channels = image.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, width * channels)], 1).tobytes()

    def part(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def png_values(values: np.ndarray, low: float, high: float, gamma: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        share = np.clip((values - low) / (high - low), 0, None) ** gamma
    return np.clip(np.floor(share * 255 + 0.5), 0, 255)


def write_png_collection(cube: Cube, path: str, bands: list[str] | None = None, low: list[float] | None = None, high: list[float] | None = None, gamma: float = 1.0, na_color: tuple[int, ...] | None = None, na_transparent: bool = True, prefix: str = "") -> int:
    """A grey (one band) or coloured (three bands) image for every slice with rows."""
    bands = list(bands or cube.bands)
    if len(bands) not in (1, 3):
        raise ValueError("images have one or three bands")
    low, high = list(low or [0.0]), list(high or [255.0])
    low, high = (v * len(bands) if len(v) == 1 else v for v in (low, high))
    labels = [_label(t) for t in cube.ref.time.labels()]

    def encode(block: np.ndarray) -> bytes:
        missing = np.isnan(block).any(0)
        layers = [png_values(v, a, b, gamma) for v, a, b in zip(block, low, high, strict=True)]
        colour = na_color or (0,)
        for k, layer in enumerate(layers):
            layer[missing] = colour[k % len(colour)]
        if na_color is None and na_transparent:
            layers.append(np.where(missing, 0, 255))
        return png(np.stack(layers, -1).astype(np.uint8))

    return place_files(_slices(cube.select_bands(bands), encode, lambda it: f"{path}/{prefix}{labels[it]}.png"))


def netcdf_bytes(values: np.ndarray, cube: Cube, low: tuple[int, int, int], packing: Packing | None = None) -> bytes:
    """A (band, t, y, x) array that starts at ``low`` of the cube's grid as a classic file."""
    r = cube.ref
    _, nt, ny, nx = values.shape
    labels = r.time.labels()[low[0] : low[0] + nt]
    origin = labels[0]
    seconds = [float(t.epoch - origin.epoch) for t in labels]
    x = r.left + (low[2] + np.arange(nx) + 0.5) * r.dx
    y = r.top - (low[1] + np.arange(ny) + 0.5) * r.dy
    about = {"Conventions": "CF-1.6", "srs": r.srs, "x_cell": r.dx, "y_cell": r.dy}
    if not isinstance(r.time, LabeledTime):
        about["time_dt"] = str(r.time.dt)
    variables = {
        "time": (["time"], np.array(seconds), {"units": f"seconds since {origin.value:%Y-%m-%dT%H:%M:%S}"}),
        "y": (["y"], y, {"axis": "Y"}),
        "x": (["x"], x, {"axis": "X"}),
    }
    classic = {"u1": "i2", "u2": "i4", "u4": "f8"}  # the classic format has no unsigned types
    for k, (name, v) in enumerate(zip(cube.bands, values, strict=True)):
        if packing is None:
            variables[name] = (["time", "y", "x"], v, {"_FillValue": float("nan")})
            continue
        scale, offset, nodata = packing.of(k, len(cube.bands))
        one = Packing(packing.kind, (scale,), (offset,), (nodata,))
        packed = packed_array(v.reshape(1, nt * ny, nx), one)[0].reshape(nt, ny, nx)
        kind = PACKINGS[packing.kind][1]
        notes = {"_FillValue": nodata} if packing.kind == "float32" else {"_FillValue": nodata, "scale_factor": scale, "add_offset": offset}
        variables[name] = (["time", "y", "x"], packed.astype(classic.get(kind, kind)), notes)
    return netcdf.write({"time": nt, "y": ny, "x": nx}, about, variables)


def write_netcdf(cube: Cube, path: str, packing: Packing | None = None) -> None:
    """One classic file; the cube has to fit the driver."""
    put_file(cube.spark, path, netcdf_bytes(cube.to_array(), cube, (0, 0, 0), packing))


def write_chunks(cube: Cube, path: str, kind: str = "netcdf", chunk_size: tuple[int, int, int] = (16, 256, 256), packing: Packing | None = None, chunks: list[int] | None = None) -> int:
    """A file for every chunk that has rows, numbered row by row, slices outermost.

    ``netcdf`` holds all bands and slices of a chunk; ``gtiff`` makes a file for every
    slice and band of it. ``chunks`` writes the numbered ones only.
    """
    r, bands = cube.ref, list(cube.bands)
    limits = (r.nt, r.ny, r.nx)
    counts = [-(-n // s) for n, s in zip(limits, chunk_size, strict=True)]
    plain = Cube.__new__(Cube)  # what the encoder reads of the cube, without its frame
    plain.ref, plain.bands = r, tuple(bands)
    labels = [_label(t) for t in r.time.labels()]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        at = [int(f[f"_c{k[1]}"].iloc[0]) for k in KEYS]
        number = (at[0] * counts[1] + at[1]) * counts[2] + at[2]
        low = tuple(c * s for c, s in zip(at, chunk_size, strict=True))
        shape = [min(s, n - a) for s, n, a in zip(chunk_size, limits, low, strict=True)]
        block = np.full((len(bands), *shape), np.nan)
        place = tuple(f[k].to_numpy() - a for k, a in zip(KEYS, low, strict=True))
        for b, band in enumerate(bands):
            block[b][place] = f[band].to_numpy(float, na_value=np.nan)
        if kind == "netcdf":
            return pd.DataFrame({"path": [f"{path}/{number}.nc"], "content": [netcdf_bytes(block, plain, low, packing)]})
        out = []
        for t in range(shape[0]):
            for b, band in enumerate(bands):
                values, nodata = packed_array(block[b : b + 1, t], packing)
                raster = geotiff.Raster(values, r.left + low[2] * r.dx, r.top - low[1] * r.dy, r.dx, r.dy, r.srs, nodata)
                out.append((f"{path}/{number}_{band}_{labels[low[0] + t]}.tif", geotiff.write(raster, True)))
        return pd.DataFrame(out, columns=["path", "content"])

    if kind not in ("netcdf", "gtiff"):
        raise ValueError(f"unknown kind {kind!r}")
    grid = chunk_grid(cube, chunk_size)
    keyed = cube.df.select(*KEYS, *cube.band_columns()).withColumns(grid)
    if chunks is not None:
        keyed = keyed.where(((F.col("_ct") * counts[1] + F.col("_cy")) * counts[2] + F.col("_cx")).isin(*chunks))
    return place_files(keyed.groupBy(*grid).applyInPandas(run, FILE_SCHEMA))
