"""Further queries with their SQL: files written and read back, programs, catalogs, expressions, views."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks, sources
from .cube import KEYS, Cube
from .operators import external
from .operators.pixel import RangeMask
from .queries import DENSE, DIGITS, E_REF, E, L, _add, _cells_sql, _collection, _items, _rounded, _table, _value
from .ref import CubeRef, CubeView
from .sources import basic
from .sources.catalog import ImageCollection, scan


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="lattix-")
    return f"{shared.rstrip('/')}/lattix-queries/{uuid.uuid4().hex}"


# -- files written and read back ---------------------------------------------------
def _parquet(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    sinks.write_cube(_value(s, d), path)
    return _rounded(sources.read_cube(s, path))


def _tiffs(s: SparkSession, d: str) -> DataFrame:
    """One file a day, read as a collection on the same grid."""
    path = _folder(s)
    sinks.write_tif_collection(_value(s, d), path, "e_")
    days = [str(t) for t in E_REF.time.labels()]
    c = ImageCollection.create_with_times(s, [f"{path}/e_{t}.tif" for t in days], days, ["value"])
    return _rounded(c.cube(CubeView(E_REF, "near", "first"), ["value"])).where("value is not null")


def _netcdf(s: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(s)}/e.nc"
    sinks.write_netcdf(_value(s, d), path)
    return _rounded(sources.from_netcdf(s, path)).where("value is not null")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks of 7 days and 5 x 6 pixels; every value and how many chunk files there are."""
    path = _folder(s)
    many = sinks.write_chunks(_value(s, d), path, "netcdf", (7, 5, 6))
    files = s.read.format("binaryFile").load(f"{path}/*.nc").count()
    return s.createDataFrame([(many, files)], "written long, found long")


for _name, _query in (("sink_parquet", _parquet), ("sink_geotiff", _tiffs), ("sink_netcdf", _netcdf)):
    _add(_name, _query, _cells_sql(E, {"value": "value"}, "e"))
_add("sink_chunks", _chunks, f"WITH {E} SELECT count(*) AS written, count(*) AS found FROM (SELECT DISTINCT it // 7, iy // 5, ix // 6 FROM e)")

# -- programs ------------------------------------------------------------------------
PROGRAM = """
import os, numpy as np
data = open(os.environ['LATTIX_STREAM_FILE_IN'], 'rb').read()
size = np.frombuffer(data, '<i4', 4)
v = np.frombuffer(data[-8 * int(np.prod(size)):], '<f8').reshape(size)
out = {out}
open(os.environ['LATTIX_STREAM_FILE_OUT'], 'wb').write(np.array(out.shape, '<i4').tobytes() + out.astype('<f8').tobytes())
"""


def _program(out: str) -> str:
    code = ";".join(PROGRAM.strip().format(out=out).split("\n"))
    return f'{sys.executable} -c "{code}"'


_add("stream", lambda s, d: _rounded(_value(s, d).stream(_program("v * 2"), (10, 8, 8))).where("band1 is not null"), _cells_sql(E, {"band1": "value * 2"}, "e"))
_add("stream_apply_pixel", lambda s, d: _rounded(external.stream_apply_pixel(_value(s, d), _program("v + 1"), 1, ["more"])), _cells_sql(E, {"more": "value + 1"}, "e"))
_add("stream_apply_time", lambda s, d: _rounded(external.stream_apply_time(_value(s, d), _program("np.nan_to_num(v).cumsum(axis=1)"), 1, ["total"])), f"WITH {E}, {DENSE} SELECT it, iy, ix, round(sum(coalesce(value, 0)) OVER (PARTITION BY iy, ix ORDER BY it), {DIGITS}) AS total FROM d")
_add("stream_reduce_time", lambda s, d: _rounded(external.stream_reduce_time(_value(s, d), _program("np.nanmax(v, axis=1, keepdims=True)"), 1, ["top"])), f"WITH {E} SELECT CAST(0 AS INT) AS it, iy, ix, round(max(value), {DIGITS}) AS top FROM e GROUP BY iy, ix")
_add("stream_reduce_space", lambda s, d: _rounded(external.stream_reduce_space(_value(s, d), _program("np.nansum(v, axis=(2, 3), keepdims=True)"), 1, ["total"])), f"WITH {E} SELECT it, CAST(0 AS INT) AS iy, CAST(0 AS INT) AS ix, round(sum(value), {DIGITS}) AS total FROM e GROUP BY it")

# -- expressions -----------------------------------------------------------------------
#: Each function with what it is applied to and the same in SQL; q is the quantity, between 1 and 50.
_CALLS = {
    "abs": ("abs(q - 25)", "abs(q - 25)"),
    "acos": ("acos(q / 60)", "acos(q / 60)"),
    "asin": ("asin(q / 60)", "asin(q / 60)"),
    "atan": ("atan(q)", "atan(q)"),
    "atan2": ("atan2(q, 3)", "atan2(q, 3)"),
    "ceil": ("ceil(q / 7.3)", "ceil(q / 7.3)"),
    "floor": ("floor(q / 7.3)", "floor(q / 7.3)"),
    "cos": ("cos(q)", "cos(q)"),
    "sin": ("sin(q)", "sin(q)"),
    "tan": ("tan(q / 60)", "tan(q / 60)"),
    "cosh": ("cosh(q / 50)", "cosh(q / 50)"),
    "sinh": ("sinh(q / 50)", "sinh(q / 50)"),
    "tanh": ("tanh(q / 50)", "tanh(q / 50)"),
    "exp": ("exp(q / 50)", "exp(q / 50)"),
    "ln": ("ln(q)", "ln(q)"),
    "log": ("log(q)", "log10(q)"),
    "log10": ("log10(q)", "log10(q)"),
    "pow": ("pow(q, 1.5)", "pow(q, 1.5)"),
    "sqrt": ("sqrt(q)", "sqrt(q)"),
    "min": ("min(q, 25)", "least(q, 25)"),
    "max": ("max(q, 25)", "greatest(q, 25)"),
    "fac": ("fac(floor(q / 10))", "CAST(factorial(CAST(floor(q / 10) AS INT)) AS DOUBLE)"),
    "ncr": ("ncr(10, floor(q / 10))", "factorial(10) / (factorial(CAST(floor(q / 10) AS INT)) * factorial(10 - CAST(floor(q / 10) AS INT))::DOUBLE)"),
    "constants": ("pi * q + e", "pi() * q + exp(1)"),
    "test": ("isnan(q) + isfinite(q) * 2", "CAST(2 AS DOUBLE)"),
    "logic": ("iif(q > 10 && q <= 30 || !(q < 45), q % 7, -q)", "CASE WHEN q > 10 AND q <= 30 OR NOT q < 45 THEN q % 7 ELSE -q END"),
}
_NAMED = {f"f_{k}": v for k, v in _CALLS.items()}
_add("expressions", lambda s, d: _rounded(_items(s, d, ("quantity",)).rename_bands({"quantity": "q"}).apply_pixel([a for a, _ in _NAMED.values()], list(_NAMED))), _cells_sql(L, {k: b for k, (_, b) in _NAMED.items()}, "(SELECT it, iy, ix, quantity AS q FROM l)"))


# -- catalogs --------------------------------------------------------------------------
def _facts(s: SparkSession, d: str) -> DataFrame:
    """Counts, alignment and default view, of a collection that was written and read."""
    path = _folder(s)
    _collection(s, d).write(path)
    c = ImageCollection.read(s, path)
    view = c.default_view()
    r = view.ref
    row = (*c.counts().values(), c.is_empty(), c.distinct_srs(), c.is_aligned(), c.pixel_size_bytes(), r.left, r.right, r.bottom, r.top, view.resampling, view.aggregation)
    return s.createDataFrame([row], "images long, bands long, refs long, is_empty boolean, srs string, aligned boolean, bytes long, left double, right double, bottom double, top double, resampling string, aggregation string")


_BOXES = "SELECT (o_custkey % 300) - 150.0::DOUBLE AS x, (o_custkey % 100) - 50.0::DOUBLE AS y, o_orderkey AS k FROM orders"
_add("catalog_facts", _facts, f"WITH b AS ({_BOXES}) SELECT count(*) AS images, CAST(2 AS BIGINT) AS bands, count(*) + count(*) FILTER (k % 2 = 0) AS refs, false AS is_empty, 'EPSG:4326' AS srs, false AS aligned, CAST(3 AS BIGINT) AS bytes, min(x) AS \"left\", max(x) + 5 AS \"right\", min(y) AS bottom, max(y) + 4 AS top, 'near' AS resampling, 'first' AS aggregation FROM b")


def _day_bands(s: SparkSession, d: str) -> DataFrame:
    """Files whose two bands are two days: every customer is a file of its own day."""
    c = F.col("c_custkey")
    files = _table(s, d, "customer").select(F.concat(F.lit("/d/t_"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(c, F.lit(300)).cast("int")), "yyyyMMdd"), F.lit("_"), c.cast("string"), F.lit(".tif")).alias("descriptor"))
    rules = {"pattern": r".*\.tif$", "images": {"pattern": r".*/(t_\d+_\d+)\.tif"}, "datetime": {"pattern": r".*/t_(\d{8})_.*", "format": "%Y%m%d", "bands": {"dt": "P1D"}}, "bands": {"first": {"band": 1}, "second": {"band": 2}}}
    return ImageCollection.create(files, rules).images.select("name", "datetime")


_add("catalog_time_bands", _day_bands, "WITH c AS (SELECT c_custkey AS k, TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 300 AS INT)) AS t FROM customer) SELECT 't_' || strftime(t, '%Y%m%d') || '_' || k || '_' || strftime(t + to_days(b), '%Y-%m-%dT%H:%M:%S') AS name, t + to_days(b) AS datetime FROM c, (VALUES (0), (1)) v(b)")


def _metadata(s: SparkSession, d: str) -> DataFrame:
    files = _table(s, d, "supplier").select(F.concat(F.lit("/d/m_20200101_"), F.col("s_suppkey").cast("string"), F.lit(".tif")).alias("descriptor"), F.create_map(F.lit("CLOUD"), F.pmod("s_suppkey", F.lit(100)).cast("string"), F.lit("OTHER"), F.lit("x")).alias("metadata"))
    rules = {"images": {"pattern": r".*/(m_\d+_\d+)\.tif"}, "datetime": {"pattern": r".*/m_(\d{8})_.*", "format": "%Y%m%d"}, "bands": {"b": {}}, "image_md_fields": ["CLOUD"]}
    c = ImageCollection.create(files, rules)
    return c.image_md.join(c.images.select(F.col("id").alias("image_id"), "name"), "image_id").select("name", "key", "value")


_add("catalog_metadata", _metadata, "SELECT 'm_20200101_' || s_suppkey AS name, 'CLOUD' AS key, CAST(s_suppkey % 100 AS VARCHAR) AS value FROM supplier")


# -- grids and masks ---------------------------------------------------------------------
def _degrees(s: SparkSession, d: str) -> DataFrame:
    """Events by degrees on a mercator grid."""
    ref = CubeRef.create(0, 2_000_000, 0, 1_000_000, nx=16, ny=8, srs="EPSG:3857", t0="2024-01-01", t1="2024-01-30", dt="P1D")
    cube = basic.from_points(_table(s, d, "events"), ref, x=F.pmod("user_id", F.lit(179)) / 10.0, y=F.pmod("user_id", F.lit(89)) / 10.0, t="ts", bands={"value": "value"}, func="count", srs="EPSG:4326")
    return _rounded(cube)


_add("reprojection", _degrees, f"WITH p AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS it, radians((user_id % 179) / 10.0) * 6378137 AS x, ln(tan(pi() / 4 + radians((user_id % 89) / 10.0) / 2)) * 6378137 AS y, value FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31') SELECT it, CAST(floor((1000000 - y) / 125000) AS INT) AS iy, CAST(floor(x / 125000) AS INT) AS ix, round(CAST(count(value) AS DOUBLE), {DIGITS}) AS value FROM p WHERE x >= 0 AND x < 2000000 AND y > 0 AND y <= 1000000 GROUP BY 1, 2, 3")


def _masked(s: SparkSession, d: str) -> DataFrame:
    """Images of every second user lack the mask band; they stay as they are."""
    rows = _table(s, d, "events")
    pixels = rows.select(F.col("event_id").alias("image_id"), (F.pmod("user_id", F.lit(16)) + 0.5).alias("x"), (8 - F.pmod(F.floor(F.col("user_id") / 16), F.lit(8)) - 0.5).alias("y"), F.lit(1.0).alias("dx"), F.lit(1.0).alias("dy"), "value", F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("k"))
    images = rows.select(F.col("event_id").alias("image_id"), F.col("ts").alias("datetime"))
    return _rounded(scan(pixels, images, CubeView(E_REF, "near", "max"), ["value"], "EPSG:3857", RangeMask(20, 1e9), "k"))


_add("mask_missing", _masked, f"SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS it, CAST((user_id // 16) % 8 AS INT) AS iy, CAST(user_id % 16 AS INT) AS ix, round(max(CASE WHEN user_id % 2 = 0 AND value BETWEEN 20 AND 1e9 THEN NULL ELSE value END), {DIGITS}) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Line items on labelled months, every second one of the axis."""
    labels = [f"{1995 + k // 12}-{k % 12 + 1:02}" for k in range(0, 84, 2)]
    ref = CubeRef.create(0, 20, 0, 20, nx=20, ny=20, srs="EPSG:3857", labels=labels)
    cube: Cube = basic.from_cells(_table(s, d, "lineitem"), ref, ix=F.pmod("l_suppkey", F.lit(20)), iy=F.pmod("l_partkey", F.lit(20)), t="l_shipdate", bands={"quantity": "l_quantity"}, func="sum")
    return _rounded(cube, KEYS)


_add("labelled_time", _labelled, f"SELECT CAST(((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) // 2 AS INT) AS it, CAST(l_partkey % 20 AS INT) AS iy, CAST(l_suppkey % 20 AS INT) AS ix, round(sum(l_quantity), {DIGITS}) AS quantity FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2001 AND (month(l_shipdate) - 1) % 2 = 0 GROUP BY 1, 2, 3")
