"""User functions on cells, series, slices and chunks, by Arrow batches.

Functions get and give numpy arrays of doubles with NaN as missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..cube import KEYS, PIXEL, Cube


def _schema(keys: tuple[str, ...], names: list[str]) -> str:
    return ", ".join([f"{k} int" for k in keys] + [f"`{n}` double" for n in names])


def _frame(keys: dict[str, np.ndarray], names: list[str], values: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({**{k: np.asarray(v, np.int32) for k, v in keys.items()}, **{n: pd.array(v, "Float64") for n, v in zip(names, values, strict=True)}})
    return out.mask(out.isna(), None) if len(out) else out


def _shaped(values: object, shape: tuple[int, ...], what: str) -> np.ndarray:
    out = np.asarray(values, float)
    if out.shape != shape:
        raise ValueError(f"the function for {what} gave shape {out.shape}, not {shape}")
    return out


def udf_pixel(cube: Cube, fn: Callable, names: list[str], keep_bands: bool) -> Cube:
    """``fn(values)`` maps (bands, n) to (names, n) for any n cells; a map without a shuffle."""
    bands, names = list(cube.bands), list(names)
    out = [*(bands if keep_bands else []), *names]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = f[bands].to_numpy(float, na_value=np.nan).T
            new = _shaped(fn(values), (len(names), len(f)), "cells")
            yield _frame({k: f[k] for k in KEYS}, out, np.concatenate([values, new]) if keep_bands else new)

    df = cube.df.select(*KEYS, *cube.band_columns()).mapInPandas(run, _schema(KEYS, out))
    return Cube(df, cube.ref, out)


def _dense(f: pd.DataFrame, bands: list[str], nt: int) -> np.ndarray:
    series = np.full((len(bands), nt), np.nan)
    series[:, f["it"].to_numpy()] = f[bands].to_numpy(float, na_value=np.nan).T
    return series


def udf_time(cube: Cube, fn: Callable, names: list[str], keep_bands: bool) -> Cube:
    """``fn(series)`` maps (bands, nt) to (names, nt) for every pixel."""
    bands, names, nt = list(cube.bands), list(names), cube.ref.nt
    out = [*(bands if keep_bands else []), *names]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        series = _dense(f, bands, nt)
        new = _shaped(fn(series), (len(names), nt), "series")
        at = {"it": np.arange(nt), "iy": np.full(nt, f["iy"].iloc[0]), "ix": np.full(nt, f["ix"].iloc[0])}
        return _frame(at, out, np.concatenate([series, new]) if keep_bands else new)

    df = cube.df.select(*KEYS, *cube.band_columns()).groupBy(*PIXEL).applyInPandas(run, _schema(KEYS, out))
    return Cube(df, cube.ref, out)


def udf_reduce_time(cube: Cube, fn: Callable, names: list[str]) -> Cube:
    """``fn(series)`` maps (bands, nt) to one value for each name, for every pixel."""
    bands, names, nt = list(cube.bands), list(names), cube.ref.nt

    def run(f: pd.DataFrame) -> pd.DataFrame:
        new = _shaped(fn(_dense(f, bands, nt)), (len(names),), "series")
        return _frame({"it": [0], "iy": f["iy"].iloc[:1], "ix": f["ix"].iloc[:1]}, names, new[:, None])

    df = cube.df.select(*KEYS, *cube.band_columns()).groupBy(*PIXEL).applyInPandas(run, _schema(KEYS, names))
    return Cube(df, cube.ref.with_(time=cube.ref.time.slice_of(0, 0)), names, reduced=cube.reduced | {"time"})


def udf_reduce_space(cube: Cube, fn: Callable, names: list[str]) -> Cube:
    """``fn(values)`` maps the (bands, n) cells of a slice to one value for each name.

    The function needs a whole slice at once, so a slice's rows meet in one task;
    ``reduce_space`` has no such limit.
    """
    bands, names = list(cube.bands), list(names)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["iy", "ix"])
        new = _shaped(fn(f[bands].to_numpy(float, na_value=np.nan).T), (len(names),), "slices")
        return _frame({"it": f["it"].iloc[:1], "iy": [0], "ix": [0]}, names, new[:, None])

    df = cube.df.select(*KEYS, *cube.band_columns()).groupBy("it").applyInPandas(run, _schema(KEYS, names))
    return Cube(df, cube.ref.with_(nx=1, ny=1), names, reduced=cube.reduced | {"space"})


def chunk_grid(cube: Cube, chunk_size: tuple[int, int, int]) -> dict:
    """Columns for the chunk a cell lies in."""
    return {f"_c{k[1]}": F.floor(F.col(k) / s).cast("int") for k, s in zip(KEYS, chunk_size, strict=True)}


def map_chunks(cube: Cube, fn: Callable, names: list[str], chunk_size: tuple[int, int, int]) -> Cube:
    """``fn(block)`` maps (bands, t, y, x) to (names, t, y, x) for every chunk that has a row."""
    bands, names, r = list(cube.bands), list(names), cube.ref
    limits = (r.nt, r.ny, r.nx)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        low = [int(f[f"_c{k[1]}"].iloc[0]) * s for k, s in zip(KEYS, chunk_size, strict=True)]
        shape = tuple(min(s, n - a) for s, n, a in zip(chunk_size, limits, low, strict=True))
        at = tuple(f[k].to_numpy() - a for k, a in zip(KEYS, low, strict=True))
        block = np.full((len(bands), *shape), np.nan)
        for b, name in enumerate(bands):
            block[b][at] = f[name].to_numpy(float, na_value=np.nan)
        new = _shaped(fn(block), (len(names), *shape), "chunks")
        keep = ~np.isnan(new).all(0)
        where = np.nonzero(keep)
        return _frame({k: w + a for k, w, a in zip(KEYS, where, low, strict=True)}, names, new[:, keep])

    grid = chunk_grid(cube, chunk_size)
    keyed = cube.df.select(*KEYS, *cube.band_columns()).withColumns(grid)
    return Cube(keyed.groupBy(*grid).applyInPandas(run, _schema(KEYS, names)), cube.ref, names)
