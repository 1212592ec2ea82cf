"""NetCDF classic files (formats 1 and 2), read and written with numpy alone."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import KEYS, Cube, cells
from ..ref import CubeRef
from ..timeaxis import Duration, LabeledTime, RegularTime, Time, Unit

#: The format's type numbers, tags and fill values.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
CODE = {"int8": 1, "char": 2, "int16": 3, "int32": 4, "float32": 5, "float64": 6}


class Reader:
    """Header of a classic file; variables are read on demand from the bytes."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2):
            raise ValueError("not a netCDF classic file")
        self.data, self.at, self.wide = data, 4, data[3] == 2
        self.records = self._int()
        self.dimensions = [(self._text(), self._int()) for _ in range(self._count(DIMENSION))]
        self.attributes = self._attributes()
        self.variables: dict[str, dict[str, Any]] = {}
        for _ in range(self._count(VARIABLE)):
            name = self._text()
            dims = [self._int() for _ in range(self._int())]
            attributes = self._attributes()
            kind, size = self._int(), self._int()
            begin = struct.unpack_from(">q" if self.wide else ">i", data, self.at)[0]
            self.at += 8 if self.wide else 4
            self.variables[name] = {"dims": dims, "attributes": attributes, "kind": TYPES[kind], "size": size, "begin": begin}

    def _int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.data, self.at - 4)[0]

    def _count(self, tag: int) -> int:
        got, n = self._int(), self._int()
        if got not in (0, tag):
            raise ValueError("the header is damaged")
        return n

    def _text(self) -> str:
        n = self._int()
        out = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return out

    def _attributes(self) -> dict[str, Any]:
        out = {}
        for _ in range(self._count(ATTRIBUTE)):
            name, kind, n = self._text(), self._int(), self._int()
            dtype = np.dtype(TYPES[kind])
            raw = np.frombuffer(self.data, dtype, n, self.at)
            self.at += -(-n * dtype.itemsize // 4) * 4
            out[name] = raw.tobytes().decode().rstrip("\0") if kind == 2 else raw[0].item() if n == 1 else raw.tolist()
        return out

    def dims_of(self, name: str) -> list[str]:
        return [self.dimensions[d][0] for d in self.variables[name]["dims"]]

    def values(self, name: str) -> np.ndarray:
        v = self.variables[name]
        sizes = [self.dimensions[d][1] for d in v["dims"]]
        dtype = np.dtype(v["kind"])
        if v["dims"] and self.dimensions[v["dims"][0]][1] == 0:  # record variable: one slice in every record
            strides = sum(x["size"] for x in self.variables.values() if x["dims"] and self.dimensions[x["dims"][0]][1] == 0)
            one = int(np.prod(sizes[1:])) if len(sizes) > 1 else 1
            parts = [np.frombuffer(self.data, dtype, one, v["begin"] + k * strides) for k in range(self.records)]
            return np.concatenate(parts).reshape(self.records, *sizes[1:]) if parts else np.zeros((0, *sizes[1:]), dtype)
        return np.frombuffer(self.data, dtype, int(np.prod(sizes)) if sizes else 1, v["begin"]).reshape(sizes)


def write(dimensions: dict[str, int], attributes: dict[str, Any], variables: dict[str, tuple[list[str], np.ndarray, dict[str, Any]]]) -> bytes:
    """A classic file with 64-bit offsets."""

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def listing(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def attribute(name: str, value: Any) -> bytes:
        if isinstance(value, str):
            raw, kind, n = value.encode(), 2, len(value.encode())
        else:
            array = np.atleast_1d(np.asarray(value))
            array = array.astype(">i4") if array.dtype.kind in "iu" else array.astype(">f8")
            raw, kind, n = array.tobytes(), 4 if array.dtype.kind == "i" else 6, array.size
        return text(name) + struct.pack(">ii", kind, n) + raw + b"\0" * (-len(raw) % 4)

    names = list(dimensions)
    bodies = []
    for dims, values, _ in variables.values():
        kind = np.asarray(values).dtype
        code = CODE.get("char" if kind.kind == "S" else kind.name)
        if code is None:
            raise ValueError(f"type {kind} has no place in a classic file")
        raw = np.ascontiguousarray(values).astype(TYPES[code]).tobytes()
        bodies.append((code, [names.index(d) for d in dims], raw + b"\0" * (-len(raw) % 4)))

    def header(begins: list[int]) -> bytes:
        listed = []
        for (name, (_, _, about)), (code, dims, raw), begin in zip(variables.items(), bodies, begins, strict=True):
            listed.append(text(name) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + listing(ATTRIBUTE, [attribute(k, v) for k, v in about.items()]) + struct.pack(">iiq", code, len(raw) if len(raw) < 1 << 31 else -1, begin))
        return b"CDF\x02" + struct.pack(">i", 0) + listing(DIMENSION, [text(n) + struct.pack(">i", s) for n, s in dimensions.items()]) + listing(ATTRIBUTE, [attribute(k, v) for k, v in attributes.items()]) + listing(VARIABLE, listed)

    at = len(header([0] * len(bodies)))
    begins = []
    for _, _, raw in bodies:
        begins.append(at)
        at += len(raw)
    return header(begins) + b"".join(raw for _, _, raw in bodies)


X_NAMES, Y_NAMES, T_NAMES = ("x", "longitude", "lon"), ("y", "latitude", "lat"), ("time", "t")


def _time_axis(values: np.ndarray, attributes: dict[str, Any], own: dict[str, Any]) -> RegularTime | LabeledTime:
    """From ``<unit> since <time>``; regular if attributes or equal steps say so."""
    words = str(attributes.get("units", "days since 1970-01-01")).split(" since ")
    unit = {"s": Unit.SECOND, "m": Unit.MINUTE, "h": Unit.HOUR, "d": Unit.DAY, "w": Unit.WEEK, "y": Unit.YEAR}[words[0].strip().lower()[0]]
    if words[0].strip().lower().startswith("month"):
        unit = Unit.MONTH
    base = Time.parse(words[1])
    base = Time(base.value, unit)
    times = [base + Duration(int(v), unit) for v in np.asarray(values, float)]
    if "time_dt" in own:
        dt = Duration.parse(own["time_dt"])
        return RegularTime.by_duration(times[0].truncate(dt.unit), times[-1].truncate(dt.unit), dt)
    steps = np.diff(np.asarray(values, float))
    if len(steps) and (steps == steps[0]).all() and steps[0] >= 1:
        step = Duration(int(steps[0]), unit)
        return RegularTime(times[0], times[-1] + Duration(step.count - 1, unit), step)
    return LabeledTime(tuple(times))


def from_netcdf(spark: SparkSession, path: str, auto_unpack: bool = True, bands: list[str] | None = None, block: int = 1 << 18) -> Cube:
    """A cube from the (t, y, x) variables of a classic file.

    The driver reads the header and the axes; tasks read the values, each variable's
    slices apart. Packed values become ``offset + scale * v`` and the no-data value missing.
    """
    files = spark.read.format("binaryFile").load(path)
    head = Reader(bytes(files.select("content").first()[0]))
    dims = {n for n, _ in head.dimensions}
    axis = {k: next((n for n in names if n in dims), None) for k, names in (("x", X_NAMES), ("y", Y_NAMES), ("t", T_NAMES))}
    if None in (axis["x"], axis["y"], axis["t"]):
        raise ValueError("the file lacks an x, y or time dimension")
    found = [n for n in head.variables if head.dims_of(n) == [axis["t"], axis["y"], axis["x"]]]
    bands = found if bands is None else [b for b in bands if b in found]
    if not bands:
        raise ValueError("the file has no (t, y, x) variable that is asked for")
    xs, ys = np.asarray(head.values(axis["x"]), float), np.asarray(head.values(axis["y"]), float)
    dx = abs(xs[-1] - xs[0]) / (len(xs) - 1) if len(xs) > 1 else float(head.attributes.get("x_cell", 1))
    dy = abs(ys[-1] - ys[0]) / (len(ys) - 1) if len(ys) > 1 else float(head.attributes.get("y_cell", 1))
    flip_x, flip_y = len(xs) > 1 and xs[0] > xs[-1], len(ys) > 1 and ys[0] < ys[-1]
    ref = CubeRef(xs.min() - dx / 2, xs.max() + dx / 2, ys.min() - dy / 2, ys.max() + dy / 2, len(xs), len(ys), str(head.attributes.get("srs", "EPSG:4326")), _time_axis(head.values(axis["t"]), head.variables[axis["t"]]["attributes"], head.attributes))
    nx, ny, nt = len(xs), len(ys), ref.nt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                reader = Reader(content.as_py())
                values = {b: reader.values(b) for b in bands}
                for start in range(0, nt * ny * nx, block):
                    i = np.arange(start, min(start + block, nt * ny * nx))
                    it, iy, ix = i // (ny * nx), i // nx % ny, i % nx
                    columns = []
                    for b in bands:
                        about = reader.variables[b]["attributes"]
                        raw = values[b].reshape(-1)[i].astype(float)
                        if auto_unpack:
                            nodata = about.get("_FillValue", about.get("missing_value"))
                            missing = raw == nodata if nodata is not None else np.zeros(len(raw), bool)
                            raw = about.get("add_offset", 0.0) + raw * about.get("scale_factor", 1.0)
                            raw[missing] = np.nan
                        columns.append(pa.array(raw))
                    keys = [pa.array(k.astype(np.int32)) for k in (it, ny - 1 - iy if flip_y else iy, nx - 1 - ix if flip_x else ix)]
                    yield pa.RecordBatch.from_arrays(keys + columns, names=[*KEYS, *bands])

    schema = ", ".join([f"{k} int" for k in KEYS] + [f"`{b}` double" for b in bands])
    df: DataFrame = files.select("content").mapInArrow(run, schema)
    about = {b: head.variables[b]["attributes"] for b in bands}
    df = df.select(*KEYS, *[F.col(f"`{b}`").alias(b, metadata={k: v for k, v in (("offset", about[b].get("add_offset", 0.0)), ("scale", about[b].get("scale_factor", 1.0)), ("unit", about[b].get("units", ""))) if v is not None}) for b in bands])
    return cells(df, ref, bands, {"cube_type": "ncdf", "file": path, "auto_unpack": auto_unpack, "band_selection": bands})
