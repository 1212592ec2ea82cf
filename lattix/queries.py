"""One query for each operator over the star-schema tables, with the same in SQL.

Cubes: events by day (E) and hour (EH) on 16 x 8 pixels, line items and orders by
month (L, O) on 20 x 20, events as images of one pixel each (S).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cube import KEYS, Cube
from .operators.join import join_bands
from .operators.pixel import RangeMask, ValueMask
from .ref import CubeRef, CubeView
from .sinks import Packing, pack
from .sources import basic
from .sources.catalog import ImageCollection, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6
SCALE = 0.7310585786  # two-digit values would often lie on a rounding edge


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("double")


def _ref(nx: int, ny: int, t0: str, t1: str, dt: str) -> CubeRef:
    return CubeRef.create(0, nx, 0, ny, nx=nx, ny=ny, srs="EPSG:3857", t0=t0, t1=t1, dt=dt)


E_REF = _ref(16, 8, "2024-01-01", "2024-01-30", "P1D")
EH_REF = _ref(16, 8, "2024-01-01T00", "2024-01-30T23", "PT1H")
L_REF = _ref(20, 20, "1995-01", "2001-12", "P1M")


def _events(spark: SparkSession, d: str, ref: CubeRef = E_REF, bands: tuple[str, ...] = ("value", "k")) -> Cube:
    rows = _table(spark, d, "events")
    columns = {"value": F.col("value"), "k": _k()}
    return basic.from_cells(rows, ref, ix=F.pmod("user_id", F.lit(16)), iy=F.pmod(F.floor(F.col("user_id") / 16), F.lit(8)), t="ts", bands={b: columns[b] for b in bands})


def _value(spark: SparkSession, d: str) -> Cube:
    return _events(spark, d, bands=("value",))


def _items(spark: SparkSession, d: str, bands: tuple[str, ...] = ("quantity", "price", "discount")) -> Cube:
    rows = _table(spark, d, "lineitem")
    columns = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": F.col("l_discount") * SCALE}
    return basic.from_cells(rows, L_REF, ix=F.pmod("l_suppkey", F.lit(20)), iy=F.pmod("l_partkey", F.lit(20)), t="l_shipdate", bands={b: columns[b] for b in bands})


def _orders(spark: SparkSession, d: str) -> Cube:
    rows = _table(spark, d, "orders")
    return basic.from_cells(rows, L_REF, ix=F.pmod("o_custkey", F.lit(20)), iy=F.pmod(F.floor(F.col("o_custkey") / 20), F.lit(20)), t="o_orderdate", bands={"totalprice": "o_totalprice"})


E = """e AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS it, CAST((user_id // 16) % 8 AS INT) AS iy, CAST(user_id % 16 AS INT) AS ix,
  avg(value) AS value, avg(CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE)) AS k
  FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3)"""
EH = """eh AS (SELECT CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS INT) AS it, CAST((user_id // 16) % 8 AS INT) AS iy, CAST(user_id % 16 AS INT) AS ix, avg(value) AS value
  FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3)"""
L = """l AS (SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS it, CAST(l_partkey % 20 AS INT) AS iy, CAST(l_suppkey % 20 AS INT) AS ix,
  avg(l_quantity) AS quantity, avg(l_extendedprice) AS price, avg(l_discount * 0.7310585786) AS discount
  FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2001 GROUP BY 1, 2, 3)"""
O = """o AS (SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS it, CAST((o_custkey // 20) % 20 AS INT) AS iy, CAST(o_custkey % 20 AS INT) AS ix, avg(o_totalprice) AS totalprice
  FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY 1, 2, 3)"""
DENSE = "d AS (SELECT CAST(t.it AS INT) AS it, p.iy, p.ix, e.value FROM (SELECT DISTINCT iy, ix FROM e) p CROSS JOIN (SELECT unnest(range(30)) AS it) t LEFT JOIN e ON e.it = t.it AND e.iy = p.iy AND e.ix = p.ix)"


def _rounded(cube: Cube, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return cube.df.select(*keys, *[F.round(c, DIGITS).alias(b) for b, c in zip(cube.bands, cube.band_columns(), strict=True)])


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _cells_sql(ctes: str, columns: dict[str, str], source: str, keys: str = "it, iy, ix", tail: str = "") -> str:
    inner = ", ".join(f"round({v}, {DIGITS}) AS \"{k}\"" for k, v in columns.items())
    return f"WITH {ctes} SELECT {keys}, {inner} FROM {source} {tail}"


AGG = {"sum": "sum({0})", "prod": "product({0})", "mean": "avg({0})", "min": "min({0})", "max": "max({0})", "count": "CAST(count({0}) AS DOUBLE)", "median": "median({0})", "var": "var_samp({0})", "sd": "stddev_samp({0})"}
REDUCE = {**AGG, "Q1": "quantile_cont({0}, 0.25)", "Q3": "quantile_cont({0}, 0.75)"}

# -- sources ---------------------------------------------------------------------
_add("from_cells", lambda s, d: _rounded(_events(s, d)), _cells_sql(E, {"value": "value", "k": "k"}, "e"))


def _points(s: SparkSession, d: str) -> DataFrame:
    rows = _table(s, d, "events")
    cube = basic.from_points(rows, E_REF, x=F.pmod("user_id", F.lit(16)) + 0.25, y=8 - (F.pmod(F.floor(F.col("user_id") / 16), F.lit(8)) + 0.75), t="ts", bands={"value": "value"}, func="max")
    return _rounded(cube)


_add("from_points", _points, _cells_sql("e AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS it, CAST((user_id // 16) % 8 AS INT) AS iy, CAST(user_id % 16 AS INT) AS ix, max(value) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3)", {"value": "value"}, "e"))
_add("dummy", lambda s, d: basic.dummy(s, E_REF, 2, 1.5).df, "SELECT CAST(t.i AS INT) AS it, CAST(y.i AS INT) AS iy, CAST(x.i AS INT) AS ix, 1.5::DOUBLE AS band1, 1.5::DOUBLE AS band2 FROM (SELECT unnest(range(30)) AS i) t, (SELECT unnest(range(8)) AS i) y, (SELECT unnest(range(16)) AS i) x")
_add("empty", lambda s, d: basic.empty(s, E_REF, 1).df, "SELECT CAST(0 AS INT) AS it, CAST(0 AS INT) AS iy, CAST(0 AS INT) AS ix, CAST(NULL AS DOUBLE) AS band1 WHERE false")


def _frames(s: SparkSession, d: str) -> DataFrame:
    """Every day is a frame, and a second frame of each third day has the values of the day before it, plus 1."""
    c = _value(s, d)
    day = lambda i: f"2024-01-{i + 1:02}"
    frames = [(day(i), c.slice_time(i).df.select("iy", "ix", "value")) for i in range(30)]
    frames += [(day(i), c.slice_time(i - 1).df.select("iy", "ix", (F.col("value") + 1).alias("value"))) for i in range(2, 30, 3)]
    return _rounded(basic.from_frames(frames, E_REF, ["value"]))


_add("simple_cube", _frames, f"WITH {E}, f AS (SELECT it, iy, ix, value, 0 AS o FROM e UNION ALL SELECT it + 1, iy, ix, value + 1, 1 FROM e WHERE it % 3 = 1) SELECT it, iy, ix, round(arg_max(value, o), {DIGITS}) AS value FROM f GROUP BY it, iy, ix")

# -- structure and cells ---------------------------------------------------------
_add("select_bands", lambda s, d: _rounded(_items(s, d).select_bands(["price", "quantity"])), _cells_sql(L, {"price": "price", "quantity": "quantity"}, "l"))
_add("rename_bands", lambda s, d: _rounded(_value(s, d).rename_bands({"value": "v", "none": "x"})), _cells_sql(E, {"v": "value"}, "e"))
_add("crop_index", lambda s, d: _rounded(_value(s, d).crop((2, 9), (1, 5), (3, 12))), _cells_sql(E, {"value": "value"}, "e", "it - 3 AS it, iy - 1 AS iy, ix - 2 AS ix", "WHERE ix BETWEEN 2 AND 9 AND iy BETWEEN 1 AND 5 AND it BETWEEN 3 AND 12"))
_add("crop_beyond", lambda s, d: _rounded(_value(s, d).crop((-2, 3), (6, 9), (0, 29))), _cells_sql(E, {"value": "value"}, "e", "it, iy - 6 AS iy, ix + 2 AS ix", "WHERE ix BETWEEN 0 AND 3 AND iy BETWEEN 6 AND 7"))
for _snap, (_x0, _x1, _y0, _y1) in {"near": (2, 8, 2, 5), "in": (3, 7, 3, 4), "out": (2, 8, 2, 5)}.items():
    _add(f"crop_snap_{_snap}", lambda s, d, snap=_snap: _rounded(_value(s, d).crop_extent(2.4, 8.6, 2.3, 5.7, "2024-01-05", "2024-01-20", snap)), _cells_sql(E, {"value": "value"}, "e", f"it - 4 AS it, iy - {_y0} AS iy, ix - {_x0} AS ix", f"WHERE ix BETWEEN {_x0} AND {_x1} AND iy BETWEEN {_y0} AND {_y1} AND it BETWEEN 4 AND 19"))
_add("select_time", lambda s, d: _rounded(_value(s, d).select_time(["2024-01-20", "2024-01-03", "2030-01-01"])), _cells_sql(E, {"value": "value"}, "e", "CAST(CASE it WHEN 2 THEN 0 ELSE 1 END AS INT) AS it, iy, ix", "WHERE it IN (2, 19)"))
_add("slice_time", lambda s, d: _rounded(_value(s, d).slice_time("2024-01-10")), _cells_sql(E, {"value": "value"}, "e", "CAST(0 AS INT) AS it, iy, ix", "WHERE it = 9"))
_add("slice_space", lambda s, d: _rounded(_value(s, d).slice_space(x=3.5, y=6.5)), _cells_sql(E, {"value": "value"}, "e", "it, CAST(0 AS INT) AS iy, CAST(0 AS INT) AS ix", "WHERE ix = 3 AND iy = 1"))
_add("apply_pixel", lambda s, d: _rounded(_items(s, d).apply_pixel(["(price - quantity) / (price + quantity)", "sqrt(abs(discount - 0.05)) * 2^2 + ix % 3", "iif(quantity > 25 && discount < 0.0371234, 1, ln(quantity))"], ["nd", "r", "c"], True)), _cells_sql(L, {"quantity": "quantity", "price": "price", "discount": "discount", "nd": "(price - quantity) / (price + quantity)", "r": "sqrt(abs(discount - 0.05)) * 4 + ix % 3", "c": "CASE WHEN quantity > 25 AND discount < 0.0371234 THEN 1.0 ELSE ln(quantity) END"}, "l"))
_add("apply_pixel_time", lambda s, d: _rounded(_value(s, d).apply_pixel(["(t1 - t0) / 3600 + it", "left + right + top + bottom"])), _cells_sql(E, {"x1": "CAST(24 + it AS DOUBLE)", "x2": "CAST(ix + ix + 1 + 8 - iy + 8 - iy - 1 AS DOUBLE)"}, "e"))
_add("filter_pixel", lambda s, d: _rounded(_events(s, d).filter_pixel("value < 50 || k >= 80")), _cells_sql(E, {"value": "CASE WHEN value < 50 OR k >= 80 THEN value END", "k": "CASE WHEN value < 50 OR k >= 80 THEN k END"}, "e"))
_WKT = "POLYGON((2 1, 13.2 1.4, 11 7.3, 5.1 6.9, 2 1), (6 3, 9 3, 9 5, 6 5, 6 3))"
_RING = "(2, 1, 13.2, 1.4), (13.2, 1.4, 11, 7.3), (11, 7.3, 5.1, 6.9), (5.1, 6.9, 2, 1), (6, 3, 9, 3), (9, 3, 9, 5), (9, 5, 6, 5), (6, 5, 6, 3)"
_INSIDE = f"w AS (SELECT p.iy, p.ix FROM (SELECT y.i AS iy, x.i AS ix, x.i + 0.5 AS px, 8 - y.i - 0.5 AS py FROM (SELECT unnest(range(8)) AS i) y, (SELECT unnest(range(16)) AS i) x) p JOIN (VALUES {_RING}) g(x0, y0, x1, y1) ON (g.y0 > p.py) <> (g.y1 > p.py) AND p.px < g.x0 + (p.py - g.y0) * (g.x1 - g.x0) / (g.y1 - g.y0) GROUP BY p.iy, p.ix HAVING count(*) % 2 = 1)"
_add("filter_geom", lambda s, d: _rounded(_value(s, d).filter_geom(_WKT)), _cells_sql(f"{E}, {_INSIDE}", {"value": "e.value"}, "e JOIN w ON w.iy = e.iy AND w.ix = e.ix", "e.it, e.iy, e.ix"))
_add("densify", lambda s, d: _rounded(_value(s, d).densify()), _cells_sql(f"{E}, {DENSE}", {"value": "value"}, "d"))

# -- masks and image slices ------------------------------------------------------
for _name, _mask, _hit in (
    ("mask_value", ValueMask((1.0, 2.0, 3.0, 5.0)), "k IN (1, 2, 3, 5)"),
    ("mask_value_invert", ValueMask(tuple(float(v) for v in range(0, 100, 2)), invert=True), "NOT (k % 2 = 0)"),
    ("mask_value_bits", ValueMask((4.0,), bits=(2,)), "(CAST(k AS BIGINT) & 4) = 4"),
    ("mask_range", RangeMask(20, 60), "k BETWEEN 20 AND 60"),
    ("mask_range_invert", RangeMask(20, 60, invert=True), "NOT (k BETWEEN 20 AND 60)"),
):
    _add(_name, lambda s, d, mask=_mask: _rounded(_scan(s, d, "max", mask=mask)), f"WITH i AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS it, CAST((user_id // 16) % 8 AS INT) AS iy, CAST(user_id % 16 AS INT) AS ix, event_id, value, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS DOUBLE) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31') SELECT it, iy, ix, round(max(CASE WHEN coalesce({_hit}, false) THEN NULL ELSE value END), {DIGITS}) AS value FROM i GROUP BY it, iy, ix")


def _scan(s: SparkSession, d: str, how: str, resampling: str = "near", mask=None) -> Cube:
    rows = _table(s, d, "events")
    pixels = rows.select(F.col("event_id").alias("image_id"), (F.pmod("user_id", F.lit(16)) + 0.5).alias("x"), (8 - F.pmod(F.floor(F.col("user_id") / 16), F.lit(8)) - 0.5).alias("y"), F.lit(1.0).alias("dx"), F.lit(1.0).alias("dy"), "value", _k().alias("k"))
    images = rows.select(F.col("event_id").alias("image_id"), F.col("ts").alias("datetime"))
    return scan(pixels, images, CubeView(E_REF, resampling, how), ["value"], "EPSG:3857", mask, "k" if mask is not None else None)


_IMAGE = "i AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS it, CAST((user_id // 16) % 8 AS INT) AS iy, CAST(user_id % 16 AS INT) AS ix, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31')"
for _how, _expr in {"none": "arg_max(value, event_id)", "first": "arg_min(value, event_id)", "last": "arg_max(value, event_id)", "min": "min(value)", "max": "max(value)", "mean": "avg(value)", "median": "median(value)", "count_values": "CAST(count(value) AS DOUBLE)"}.items():
    _add(f"pixel_agg_{_how}", lambda s, d, how=_how: _rounded(_scan(s, d, how)), f"WITH {_IMAGE} SELECT it, iy, ix, round({_expr}, {DIGITS}) AS value FROM i GROUP BY it, iy, ix")
_add("pixel_agg_count_images", lambda s, d: _rounded(_scan(s, d, "count_images")), f"WITH {_IMAGE}, n AS (SELECT it, CAST(count(DISTINCT event_id) AS DOUBLE) AS n FROM i GROUP BY it) SELECT DISTINCT i.it, i.iy, i.ix, n.n AS value FROM i JOIN n ON n.it = i.it")


def _resampled(s: SparkSession, d: str, method: str) -> DataFrame:
    """Every day is an image of 16 x 8 pixels, put on cells of 2 x 2 pixels."""
    c = _value(s, d)
    coarse = CubeRef.create(0, 16, 0, 8, nx=8, ny=4, srs="EPSG:3857", t0="2024-01-01", t1="2024-01-30", dt="P1D")
    pixels = c.df.select(F.col("it").cast("long").alias("image_id"), (F.col("ix") + 0.5).alias("x"), (8 - F.col("iy") - 0.5).alias("y"), F.lit(1.0).alias("dx"), F.lit(1.0).alias("dy"), "value")
    images = s.range(30).select(F.col("id").alias("image_id"), F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")).alias("datetime"))
    pixels = pixels.withColumn("value", F.floor(F.col("value") / 30) * 30.0 if method == "mode" else F.col("value") * SCALE)
    return _rounded(scan(pixels, images, CubeView(coarse, method, "first"), ["value"], "EPSG:3857"))


ER = E.replace("avg(value) AS value", "avg(value) * 0.7310585786 AS value")
for _method, _expr in {"average": "avg(value)", "min": "min(value)", "max": "max(value)", "med": "median(value)", "q1": "quantile_cont(value, 0.25)", "q3": "quantile_cont(value, 0.75)"}.items():
    _add(f"resample_{_method}", lambda s, d, m=_method: _resampled(s, d, m), f"WITH {ER} SELECT it, CAST(iy // 2 AS INT) AS iy, CAST(ix // 2 AS INT) AS ix, round({_expr}, {DIGITS}) AS value FROM e GROUP BY 1, 2, 3")
# of values that are as frequent the smallest counts
_add("resample_mode", lambda s, d: _resampled(s, d, "mode"), f"WITH {E}, n AS (SELECT it, iy // 2 AS y, ix // 2 AS x, floor(value / 30) * 30.0 AS v, count(*) AS n FROM e WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT it, CAST(y AS INT) AS iy, CAST(x AS INT) AS ix, arg_min(v, -n * 1e9 + v) AS value FROM n GROUP BY it, y, x")
# the centre of a coarse cell is a corner of four pixels; the one to its lower right starts there
_add("resample_near", lambda s, d: _resampled(s, d, "near"), f"WITH {ER} SELECT it, CAST(iy // 2 AS INT) AS iy, CAST(ix // 2 AS INT) AS ix, round(value, {DIGITS}) AS value FROM e WHERE iy % 2 = 1 AND ix % 2 = 1")
# a kernel's weights at a distance of q pixels from the cell's centre, at cells of two pixels
_WEIGHT = {
    "bilinear": (1, "greatest(0, 1 - {d})"),
    "cubic": (2, "CASE WHEN {d} <= 1 THEN 1.5 * {d} ^ 3 - 2.5 * {d} ^ 2 + 1 WHEN {d} < 2 THEN -0.5 * {d} ^ 3 + 2.5 * {d} ^ 2 - 4 * {d} + 2 ELSE 0 END"),
    "cubicspline": (2, "CASE WHEN {d} <= 1 THEN 2 / 3.0 - {d} ^ 2 + {d} ^ 3 / 2 WHEN {d} < 2 THEN (2 - {d}) ^ 3 / 6 ELSE 0 END"),
    "lanczos": (3, "CASE WHEN {d} < 1e-9 THEN 1 WHEN {d} < 3 THEN 3 * sin(pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d}) ^ 2 ELSE 0 END"),
}
for _method, (_radius, _weight) in _WEIGHT.items():
    _wx, _wy = (_weight.format(d=f"(abs(2 * c.{k} + 1 - e.{k} - 0.5) / 2)") for k in ("ix", "iy"))
    _add(f"resample_{_method}", lambda s, d, m=_method: _resampled(s, d, m), f"WITH {ER}, c AS (SELECT y.i AS iy, x.i AS ix FROM (SELECT unnest(range(4)) AS i) y, (SELECT unnest(range(8)) AS i) x), w AS (SELECT e.it, c.iy, c.ix, e.value, ({_wx}) * ({_wy}) AS w FROM c JOIN e ON abs(2 * c.ix + 1 - e.ix - 0.5) <= {2 * _radius} AND abs(2 * c.iy + 1 - e.iy - 0.5) <= {2 * _radius}) SELECT it, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, round(sum(value * w) / sum(CASE WHEN value IS NOT NULL THEN w END), {DIGITS}) AS value FROM w GROUP BY it, iy, ix")

# -- reductions ------------------------------------------------------------------
for _f, _sql in REDUCE.items():
    _add(f"reduce_time_{_f.lower()}", lambda s, d, f=_f: _rounded(_items(s, d, ("discount",)).reduce_time([(f, "discount")])), f"WITH {L} SELECT CAST(0 AS INT) AS it, iy, ix, round({_sql.format('discount')}, {DIGITS}) AS \"discount_{_f}\" FROM l GROUP BY iy, ix")
for _f, _m in (("which_min", "min"), ("which_max", "max")):
    _add(f"reduce_time_{_f}", lambda s, d, f=_f: _rounded(_value(s, d).reduce_time([(f, "value")])), f"WITH {E}, m AS (SELECT iy, ix, {_m}(value) AS v FROM e GROUP BY iy, ix) SELECT CAST(0 AS INT) AS it, e.iy, e.ix, CAST(strftime(DATE '2024-01-01' + CAST(min(e.it) AS INT), '%Y%m%d') AS DOUBLE) AS value_{_f} FROM e JOIN m ON m.iy = e.iy AND m.ix = e.ix AND m.v = e.value GROUP BY e.iy, e.ix")
_add("reduce_time_filtered", lambda s, d: _rounded(_value(s, d).filter_pixel("value > 1e9").reduce_time([("sum", "value"), ("prod", "value"), ("count", "value"), ("mean", "value")])), f"WITH {E} SELECT CAST(0 AS INT) AS it, iy, ix, 0.0::DOUBLE AS value_sum, 1.0::DOUBLE AS value_prod, 0.0::DOUBLE AS value_count, CAST(NULL AS DOUBLE) AS value_mean FROM e GROUP BY iy, ix")
for _f, _sql in AGG.items():
    _band = "discount" if _f != "prod" else "unit"
    _add(f"reduce_space_{_f}", lambda s, d, f=_f: _rounded(_unit(_items(s, d, ("discount",)), f).reduce_space([(f, "discount" if f != "prod" else "unit")])), f"WITH {L} SELECT it, CAST(0 AS INT) AS iy, CAST(0 AS INT) AS ix, round({_sql.format('discount' if _f != 'prod' else '(1 + (discount - 0.05) / 100)')}, {DIGITS}) AS {_band}_{_f} FROM l GROUP BY it")


def _unit(cube: Cube, f: str) -> Cube:
    """Products of many values stay near 1."""
    return cube.apply_pixel("1 + (discount - 0.05) / 100", ["unit"]) if f == "prod" else cube


for _f, _sql in AGG.items():
    _add(f"aggregate_time_{_f}", lambda s, d, f=_f: _rounded(_items(s, d, ("discount",)).aggregate_time("P3M", f)), f"WITH {L} SELECT CAST(it // 3 AS INT) AS it, iy, ix, round({_sql.format('discount')}, {DIGITS}) AS discount FROM l GROUP BY 1, 2, 3")
    _add(f"aggregate_space_{_f}", lambda s, d, f=_f: _rounded(_items(s, d, ("discount",)).aggregate_space(5, 4, f)), f"WITH {L} SELECT it, CAST(iy // 4 AS INT) AS iy, CAST(ix // 5 AS INT) AS ix, round({_sql.format('discount')}, {DIGITS}) AS discount FROM l GROUP BY 1, 2, 3")
_add("aggregate_time_hours", lambda s, d: _rounded(_events(s, d, EH_REF, ("value",)).aggregate_time("P1D", "mean")), f"WITH {EH} SELECT CAST(it // 24 AS INT) AS it, iy, ix, round(avg(value), {DIGITS}) AS value FROM eh GROUP BY 1, 2, 3")
_add("aggregate_time_factor", lambda s, d: _rounded(_items(s, d, ("price",)).aggregate_time(fact=12, func="max")), f"WITH {L} SELECT CAST(it // 12 AS INT) AS it, iy, ix, round(max(price), {DIGITS}) AS price FROM l GROUP BY 1, 2, 3")

# -- series ----------------------------------------------------------------------
_OVER = "OVER (PARTITION BY iy, ix ORDER BY it ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"
for _f in ("mean", "sum", "prod", "count", "min", "max", "median"):
    _v = f"{AGG[_f].format('value')}".replace("CAST(count(value) AS DOUBLE)", "count(value)")
    _wrapped = {"sum": f"coalesce({_v} {_OVER}, 0)", "prod": f"coalesce({_v} {_OVER}, 1)", "count": f"CAST({_v} {_OVER} AS DOUBLE)"}.get(_f, f"{_v} {_OVER}")
    if _f == "prod":
        _wrapped = f"coalesce(product(1 + value / 1000) {_OVER}, 1)"
    _add(f"window_time_{_f}", lambda s, d, f=_f: _rounded((_value(s, d) if f != "prod" else _value(s, d).apply_pixel("1 + value / 1000", ["value"])).window_time([(f, "value")], left=2, right=1)), f"WITH {E}, {DENSE} SELECT it, iy, ix, round({_wrapped}, {DIGITS}) AS value_{_f} FROM d")
_LAG = "OVER (PARTITION BY iy, ix ORDER BY it)"
_add("window_time_kernel", lambda s, d: _rounded(_value(s, d).window_time(kernel=[-1, 2, -1])), f"WITH {E}, {DENSE} SELECT it, iy, ix, round(-lag(value, 1) {_LAG} + 2 * value - lead(value, 1) {_LAG}, {DIGITS}) AS value FROM d")
_FILL = f"{E}, {DENSE}, f AS (SELECT it, iy, ix, value, last_value(value IGNORE NULLS) OVER b AS v0, first_value(value IGNORE NULLS) OVER a AS v1, max(CASE WHEN value IS NOT NULL THEN it END) OVER b AS t0, min(CASE WHEN value IS NOT NULL THEN it END) OVER a AS t1 FROM d WINDOW b AS (PARTITION BY iy, ix ORDER BY it ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY iy, ix ORDER BY it ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
for _f, _sql in {"locf": "v0", "nocb": "v1", "near": "CASE WHEN v0 IS NULL OR t1 - it < it - t0 THEN v1 ELSE v0 END", "linear": "CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (it - t0) / (t1 - t0) END"}.items():
    _add(f"fill_time_{_f}", lambda s, d, f=_f: _rounded(_value(s, d).fill_time(f)), f"WITH {_FILL} SELECT it, iy, ix, round({_sql}, {DIGITS}) AS value FROM f")

# -- joins and vectors -----------------------------------------------------------
_add("join_bands", lambda s, d: _rounded(join_bands([_items(s, d, ("price",)), _orders(s, d)], ["L", "O"])), f"WITH {L}, {O} SELECT coalesce(l.it, o.it) AS it, coalesce(l.iy, o.iy) AS iy, coalesce(l.ix, o.ix) AS ix, round(l.price, {DIGITS}) AS \"L.price\", round(o.totalprice, {DIGITS}) AS \"O.totalprice\" FROM l FULL JOIN o ON l.it = o.it AND l.iy = o.iy AND l.ix = o.ix")


def _places(s: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return _table(s, d, "customer").select(c.alias("id"), (F.pmod(c * 7, F.lit(180)) / 10 - 1).alias("x"), (F.pmod(c * 13, F.lit(100)) / 10 - 1).alias("y"), F.date_format(F.date_add(F.lit("2023-12-30").cast("date"), F.pmod(c, F.lit(34)).cast("int")), "yyyy-MM-dd").alias("t"))


_PLACES = "p AS (SELECT c_custkey AS id, (c_custkey * 7) % 180 / 10.0 - 1 AS x, (c_custkey * 13) % 100 / 10.0 - 1 AS y, DATE '2023-12-30' + CAST(c_custkey % 34 AS INT) AS t FROM customer)"
_add("query_points", lambda s, d: _value(s, d).query_points(_places(s, d)).select("id", F.round("value", DIGITS).alias("value")), f"WITH {E}, {_PLACES} SELECT p.id, round(e.value, {DIGITS}) AS value FROM p LEFT JOIN e ON e.it = date_diff('day', DATE '2024-01-01', p.t) AND e.ix = CAST(floor(p.x) AS INT) AND e.iy = CAST(floor(8 - p.y) AS INT)")
_add("query_timeseries", lambda s, d: _value(s, d).query_timeseries(_places(s, d).select("id", "x", "y")).select("id", "it", F.round("value", DIGITS).alias("value")), f"WITH {E}, {_PLACES} SELECT p.id, CAST(t.i AS INT) AS it, round(e.value, {DIGITS}) AS value FROM p CROSS JOIN (SELECT unnest(range(30)) AS i) t LEFT JOIN e ON e.it = t.i AND e.ix = CAST(floor(p.x) AS INT) AND e.iy = CAST(floor(8 - p.y) AS INT)")
_BOXES = [(1, 0, 0, 4, 3), (2, 3.2, 2.1, 9.7, 6.4), (3, 10, 4, 16, 8), (4, 3.6, 3.6, 3.9, 3.9)]


def _features(s: SparkSession) -> DataFrame:
    rows = [(i, f"POLYGON(({a} {b}, {c} {b}, {c} {e}, {a} {e}, {a} {b}))", f"2024-01-{i * 5:02}") for i, a, b, c, e in _BOXES]
    return s.createDataFrame(rows, "fid long, wkt string, t string")


_BOX = f"b(fid, x0, y0, x1, y1) AS (VALUES {', '.join(map(str, _BOXES))})"
_IN = "e.ix + 0.5 >= b.x0 AND e.ix + 0.5 < b.x1 AND 8 - e.iy - 0.5 >= b.y0 AND 8 - e.iy - 0.5 < b.y1"
_add("extract", lambda s, d: _value(s, d).extract(_features(s)).select("fid", *KEYS, F.round("value", DIGITS).alias("value")), f"WITH {E}, {_BOX} SELECT CAST(b.fid AS BIGINT) AS fid, e.it, e.iy, e.ix, round(e.value, {DIGITS}) AS value FROM b JOIN e ON {_IN}")
_add("extract_time", lambda s, d: _value(s, d).extract(_features(s), "t").select("fid", *KEYS, F.round("value", DIGITS).alias("value")), f"WITH {E}, {_BOX} SELECT CAST(b.fid AS BIGINT) AS fid, e.it, e.iy, e.ix, round(e.value, {DIGITS}) AS value FROM b JOIN e ON {_IN} AND e.it = b.fid * 5 - 1")
_ZONAL = {"count": "CAST(count(value) AS DOUBLE)", "sum": "sum(value)", "mean": "avg(value)", "min": "min(value)", "max": "max(value)", "median": "median(value)", "var": "CASE WHEN count(value) > 1 THEN var_pop(value) END", "sd": "CASE WHEN count(value) > 1 THEN stddev_pop(value) END", "prod": "product(1 + value / 1000)"}
_add("zonal_statistics", lambda s, d: _zonal(s, d), f"WITH {ER}, {_BOX} SELECT CAST(f.fid AS BIGINT) AS fid, CAST(t.i AS INT) AS it, {', '.join((f'coalesce(z.v_{k}, 0)' if k == 'count' else f'round(z.v_{k}, {DIGITS})') + f' AS value_{k}' if k != 'prod' else f'round(z.v_prod, {DIGITS}) AS unit_prod' for k in _ZONAL)} FROM b f CROSS JOIN (SELECT unnest(range(30)) AS i) t LEFT JOIN (SELECT b.fid, e.it, {', '.join(f'{v} AS v_{k}' for k, v in _ZONAL.items())} FROM b JOIN e ON {_IN} GROUP BY b.fid, e.it) z ON z.fid = f.fid AND z.it = t.i")


def _zonal(s: SparkSession, d: str) -> DataFrame:
    cube = _value(s, d).apply_pixel(f"value * {SCALE}", ["value"]).apply_pixel("1 + value / 1000", ["unit"], True)
    spec = [(f, "value" if f != "prod" else "unit") for f in _ZONAL]
    out = cube.zonal_statistics(_features(s), spec)
    return out.select("fid", "it", *[F.round(F.col(f"{b}_{f}"), DIGITS).alias(f"{b}_{f}") for f, b in spec])


# -- catalog ---------------------------------------------------------------------
def _collection(s: SparkSession, d: str) -> ImageCollection:
    """Every order is an image file of two bands; odd orders lack the second."""
    o = _table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"), F.col("o_custkey").alias("c"))
    stem = F.concat(F.lit("/data/S_"), F.date_format("t", "yyyyMMdd"), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    box = {"left": F.pmod("c", F.lit(300)) - 150.0, "bottom": F.pmod("c", F.lit(100)) - 50.0}
    files = o.select(F.explode(F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("B01"), F.lit("B02"))).otherwise(F.array(F.lit("B01")))).alias("b"), stem.alias("stem"), box["left"].alias("left"), (box["left"] + 5).alias("right"), box["bottom"].alias("bottom"), (box["bottom"] + 4).alias("top"))
    files = files.select(F.concat("stem", F.lit("_"), "b", F.lit(".tif")).alias("descriptor"), "left", "right", "bottom", "top", F.lit("EPSG:4326").alias("proj"))
    rules = {"pattern": r".*\.tif$", "images": {"pattern": r".*/(S_\d+_\d+)_B.*"}, "datetime": {"pattern": r".*/S_(\d{8})_.*", "format": "%Y%m%d"}, "bands": {"B01": {"pattern": r".*_B01\.tif$", "type": "int16", "nodata": 0}, "B02": {"pattern": r".*_B02\.tif$", "type": "uint8"}}}
    return ImageCollection.create(files, rules)


_CAT = "c AS (SELECT o_orderkey AS k, 'S_' || strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS name, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS datetime, (o_custkey % 300) - 150.0::DOUBLE AS \"left\", (o_custkey % 100) - 50.0::DOUBLE AS bottom FROM orders)"
_add("catalog_images", lambda s, d: _collection(s, d).images.select("name", "left", "right", "bottom", "top", "datetime"), f"WITH {_CAT} SELECT name, \"left\", \"left\" + 5 AS \"right\", bottom, bottom + 4 AS top, datetime FROM c")
_add("catalog_bands", lambda s, d: _collection(s, d).all_bands().select("name", "type", "image_count"), f"WITH {_CAT} SELECT 'B01' AS name, 'int16' AS type, count(*) AS image_count FROM c UNION ALL SELECT 'B02', 'uint8', count(*) FROM c WHERE k % 2 = 0")
_add("catalog_extent", lambda s, d: _collection(s, d).extent(), f"WITH {_CAT} SELECT min(\"left\") AS \"left\", max(\"left\" + 5) AS \"right\", min(bottom) AS bottom, max(bottom + 4) AS top, min(datetime) AS t0, max(datetime) AS t1 FROM c")
_add("catalog_filter", lambda s, d: _collection(s, d).filter_bands(["B02"]).filter_datetime_range("1996-01-01", "1996-06-30").filter_spatial_range(-20, 30, -10, 25).refs.join(_collection(s, d).images.select(F.col("id").alias("image_id"), "name"), "image_id").select("name", "descriptor"), f"WITH {_CAT} SELECT name, '/data/' || name || '_B02.tif' AS descriptor FROM c WHERE k % 2 = 0 AND datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30' AND NOT (\"left\" + 5 < -20 OR \"left\" > 30 OR bottom > 25 OR bottom + 4 < -10)")
_add("catalog_find_range", lambda s, d: _collection(s, d).find_range(0, 40, 0, 40, "1997-02-01", "1997-03-15", bands=["B01"], order_by=["images.name"]).select("image_name", "descriptor", "band_name", "band_num"), f"WITH {_CAT} SELECT name AS image_name, '/data/' || name || '_B01.tif' AS descriptor, 'B01' AS band_name, CAST(1 AS INT) AS band_num FROM c WHERE datetime BETWEEN TIMESTAMP '1997-02-01' AND TIMESTAMP '1997-03-15' AND NOT (\"left\" + 5 < 0 OR \"left\" > 40 OR bottom > 40 OR bottom + 4 < 0)")

# -- packing and user functions --------------------------------------------------
_add("pack_uint8", lambda s, d: pack(_value(s, d), Packing("uint8", (0.5,), (1.0,), (255.0,))), f"WITH {E} SELECT it, iy, ix, CAST(least(greatest(round((value - 1) / 0.5), 0), 255) AS SMALLINT) AS value FROM e")
_add("udf_pixel", lambda s, d: _rounded(_value(s, d).udf_pixel(lambda v: np.sqrt(np.abs(v)), ["root"])), _cells_sql(E, {"root": "sqrt(abs(value))"}, "e"))
_add("udf_time", lambda s, d: _rounded(_value(s, d).udf_time(lambda v: np.nan_to_num(v).cumsum(1), ["total"])), f"WITH {E}, {DENSE} SELECT it, iy, ix, round(sum(coalesce(value, 0)) OVER (PARTITION BY iy, ix ORDER BY it), {DIGITS}) AS total FROM d")
_add("udf_reduce_time", lambda s, d: _rounded(_value(s, d).udf_reduce_time(lambda v: np.array([np.nanmax(v) - np.nanmin(v)]), ["span"])), f"WITH {E} SELECT CAST(0 AS INT) AS it, iy, ix, round(max(value) - min(value), {DIGITS}) AS span FROM e GROUP BY iy, ix")
_add("udf_reduce_space", lambda s, d: _rounded(_value(s, d).udf_reduce_space(lambda v: np.array([np.nanmax(v)]), ["top"])), f"WITH {E} SELECT it, CAST(0 AS INT) AS iy, CAST(0 AS INT) AS ix, round(max(value), {DIGITS}) AS top FROM e GROUP BY it")
_add("map_chunks", lambda s, d: _rounded(_value(s, d).map_chunks(lambda v: v * 2, ["twice"], (10, 4, 5))), _cells_sql(E, {"twice": "value * 2"}, "e"))


def _plan(s: SparkSession, d: str) -> DataFrame:
    plan = {"cube_type": "reduce_time", "reducer_bands": [["mean", "x1"], ["count", "x1"]], "in_cube": {"cube_type": "apply_pixel", "expr": ["band1 * ix + it"], "in_cube": {"cube_type": "crop", "ix_min": 0, "ix_max": 3, "iy_min": 0, "iy_max": 1, "it_min": 0, "it_max": 9, "in_cube": {"cube_type": "dummy", "view": CubeView(E_REF).to_json(), "nbands": 1, "fill": 2.0}}}}
    return _rounded(Cube.from_json(s, plan))


_add("json_plan", _plan, "SELECT CAST(0 AS INT) AS it, CAST(y.i AS INT) AS iy, CAST(x.i AS INT) AS ix, CAST(2 * x.i + 4.5 AS DOUBLE) AS x1_mean, 10.0::DOUBLE AS x1_count FROM (SELECT unnest(range(2)) AS i) y, (SELECT unnest(range(4)) AS i) x")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Mean and number of values of every pixel over January 2024."""
    return _rounded(_value(s, d).reduce_time([("mean", "value"), ("count", "value")]), ("iy", "ix"))


_add("flagship", flagship, f"WITH {E} SELECT iy, ix, round(avg(value), {DIGITS}) AS value_mean, CAST(count(value) AS DOUBLE) AS value_count FROM e GROUP BY iy, ix")
