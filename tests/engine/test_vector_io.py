"""Geometry, vector queries, user functions, files, catalog and streams."""

import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix import sinks, sources
from lattix.cube import Cube
from lattix.operators import external
from lattix.operators.geometry import parse_wkt, runs
from lattix.plans import cli
from lattix.ref import CubeRef, CubeView
from lattix.sources import basic, geotiff, netcdf
from lattix.sources.catalog import ImageCollection, time_pattern
from lattix.streaming import aggregate_stream, stream_cells

R = CubeRef.create(0, 6, 0, 4, nx=6, ny=4, srs="EPSG:3857", t0="2018-01-01", t1="2018-01-03", dt="P1D")


def cube(spark):
    return basic.dummy(spark, R).apply_pixel("ix + 10 * iy + 100 * it", ["v"])


def covered(wkt):
    return {(iy, ix) for iy, a, b in runs(parse_wkt(wkt), R) for ix in range(a, b + 1)}


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
    return odd


def test_polygon_cells_against_even_odd_rule():
    rng = np.random.default_rng(3)
    for _ in range(40):
        ring = [tuple(p) for p in rng.uniform(-1, 7, (5, 2)).round(3)]
        hole = [tuple(p) for p in rng.uniform(1, 4, (3, 2)).round(3)]
        text = ", ".join(f"({', '.join(f'{x} {y}' for x, y in [*r, r[0]])})" for r in (ring, hole))
        want = {(iy, ix) for iy in range(4) for ix in range(6) if inside(ix + 0.5, 4 - iy - 0.5, [ring, hole])}
        assert covered(f"POLYGON({text})") == want


def test_other_geometries():
    assert covered("POINT(1.5 0.5)") == {(3, 1)}
    assert covered("MULTIPOINT((0.1 3.9), 5.5 3.5, (9 9))") == {(0, 0), (0, 5)}
    assert covered("LINESTRING(0.5 0.5, 3.5 0.5)") == {(3, 0), (3, 1), (3, 2), (3, 3)}
    assert len(covered("MULTIPOLYGON(((0 0, 1 0, 1 1, 0 1, 0 0)), ((4 2, 6 2, 6 4, 4 4, 4 2)))")) == 5
    for bad in ("POLYGON((0 0, 1 1", "CIRCLE(1 2)", "POINT EMPTY", "1 2"):
        with pytest.raises(ValueError):
            parse_wkt(bad)


def test_filter_geom(spark):
    got = cube(spark).filter_geom("POLYGON((1 1, 4 1, 4 3, 1 3, 1 1))")
    assert {(r["iy"], r["ix"]) for r in got.df.collect()} == {(y, x) for y in (1, 2) for x in (1, 2, 3)}
    assert got.ref == R
    with pytest.raises(ValueError, match="within"):
        cube(spark).filter_geom("POLYGON((1 1, 9 1, 9 3, 1 3, 1 1))")


def test_points(spark):
    p = spark.createDataFrame([(1, 0.5, 3.5, "2018-01-02"), (2, 5.5, 0.5, "2018-01-03T10:00:00"), (3, 9.0, 1.0, "2018-01-01"), (4, 1.0, 1.0, "2017-12-31"), (5, None, 1.0, None)], "id int, x double, y double, t string")
    assert {r["id"]: r["v"] for r in cube(spark).query_points(p).collect()} == {1: 100.0, 2: 235.0, 3: None, 4: None, 5: None}
    s = cube(spark).query_timeseries(p.where("id < 3").select("id", "x", "y")).collect()
    assert sorted((r["id"], r["it"], r["v"]) for r in s) == [(1, 0, 0.0), (1, 1, 100.0), (1, 2, 200.0), (2, 0, 35.0), (2, 1, 135.0), (2, 2, 235.0)]
    degrees = spark.createDataFrame([(1, 2.5 / 111319.49079327358, 1.5 / 111319.49079327358, "2018-01-01")], "id int, x double, y double, t string")
    assert cube(spark).query_points(degrees, "EPSG:4326").first()["v"] == 22.0
    with pytest.raises(NotImplementedError):
        cube(spark).query_points(degrees, "EPSG:2154").collect()


def test_zonal_and_extract(spark):
    f = spark.createDataFrame([(1, "POLYGON((0 0, 2 0, 2 1, 0 1, 0 0))", "2018-01-02"), (2, "POLYGON((5 3, 6 3, 6 4, 5 4, 5 3))", "2018-01-01"), (3, "POLYGON((7 7, 8 7, 8 8, 7 7))", "2018-01-01")], "fid int, wkt string, t string")
    z = {(r["fid"], r["it"]): r for r in cube(spark).zonal_statistics(f, [("mean", "v"), ("var", "v"), ("count", "v")]).collect()}
    assert len(z) == 9
    assert (z[1, 0]["v_mean"], z[1, 0]["v_var"], z[1, 0]["v_count"]) == (30.5, 0.25, 2)
    assert (z[2, 1]["v_mean"], z[2, 1]["v_var"], z[3, 1]["v_mean"], z[3, 1]["v_count"]) == (105.0, None, None, 0)
    assert cube(spark).extract(f).count() == 9
    assert sorted(r["v"] for r in cube(spark).extract(f, "t").collect()) == [5.0, 130.0, 131.0]


def test_user_functions(spark):
    c = cube(spark)
    assert np.allclose(c.udf_pixel(lambda v: v + 1, ["w"]).to_array(), c.to_array() + 1)
    assert c.udf_pixel(lambda v: v * 0, ["w"], True).bands == ("v", "w")
    assert np.allclose(c.udf_time(lambda v: v[:, ::-1], ["w"]).to_array(), c.to_array()[:, ::-1])
    assert c.udf_reduce_time(lambda v: [v.sum()], ["s"]).to_array()[0, 0, 1, 2] == 336
    assert c.udf_reduce_space(lambda v: [v.max()], ["m"]).to_array()[0, 2, 0, 0] == 235
    assert np.allclose(c.map_chunks(lambda v: v - 1, ["w"], (2, 3, 4)).to_array(), c.to_array() - 1)


PROGRAM = """
import os, numpy as np
data = open(os.environ["LATTIX_STREAM_FILE_IN"], "rb").read()
size = np.frombuffer(data, "<i4", 4)
values = np.frombuffer(data[-8 * int(np.prod(size)):], "<f8").reshape(size)
out = values * 2
if {reduce!r}:
    out = out.sum(axis={reduce!r}, keepdims=True)
open(os.environ["LATTIX_STREAM_FILE_OUT"], "wb").write(np.array(out.shape, "<i4").tobytes() + out.tobytes())
"""


def program(tmp_path, reduce=()):
    path = tmp_path / f"p{len(reduce)}{sum(reduce)}.py"
    path.write_text(PROGRAM.format(reduce=tuple(reduce)))
    return f"{sys.executable} {path}"


def test_programs(spark, tmp_path):
    c = cube(spark)
    twice = program(tmp_path)
    assert np.allclose(c.stream(twice, (2, 4, 4)).to_array(), 2 * c.to_array())
    assert np.allclose(external.stream_apply_time(c, twice, 1).to_array(), 2 * c.to_array())
    assert np.allclose(external.stream_apply_pixel(c, twice, 1).to_array(), 2 * c.to_array())
    assert external.stream_reduce_time(c, program(tmp_path, (1,)), 1).to_array()[0, 0, 0, 1] == 606
    assert external.stream_reduce_space(c, program(tmp_path, (3,)), 1).to_array()[0, 0, 0, 0] == 2 * sum(x + 10 * y for x in range(6) for y in range(4))
    with pytest.raises(RuntimeError, match="ended with"):
        c.stream(f"{sys.executable} -c 'raise SystemExit(3)'")


def test_netcdf_round_trip(spark, tmp_path):
    c = cube(spark).filter_pixel("v != 111")
    path = f"{tmp_path}/c.nc"
    sinks.write_netcdf(c, path)
    again = sources.from_netcdf(spark, path)
    assert np.array_equal(again.to_array(), c.to_array(), equal_nan=True)
    assert (again.ref.nx, again.ref.left, again.ref.srs, str(again.ref.time.t0), again.ref.nt) == (6, 0, "EPSG:3857", "2018-01-01", 3)
    sinks.write_netcdf(c, path, sinks.Packing("int16", (0.5,), (10.0,)))
    packed = sources.from_netcdf(spark, path)
    assert np.array_equal(packed.to_array(), c.to_array(), equal_nan=True)
    assert netcdf.Reader(open(path, "rb").read()).values("v").dtype == ">i2"
    assert sources.from_netcdf(spark, path, auto_unpack=False).to_array().max() > 400
    with pytest.raises(ValueError):
        netcdf.Reader(b"nothing")


def test_geotiff_round_trip():
    v = np.arange(24, dtype="f8").reshape(2, 3, 4)
    for compress in (False, True):
        r = geotiff.read(geotiff.write(geotiff.Raster(v, 10.0, 50.0, 0.5, 0.25, "EPSG:4326", -9.0), compress))
        assert np.array_equal(r.values, v) and (r.left, r.top, r.dx, r.dy, r.srs, r.nodata) == (10, 50, 0.5, 0.25, "EPSG:4326", -9)


def test_image_files_and_chunks(spark, tmp_path):
    c = cube(spark)
    assert sinks.write_tif_collection(c, f"{tmp_path}/t", "a_", sinks.Packing("int16")) == 3
    r = geotiff.read(open(f"{tmp_path}/t/a_2018-01-02.tif", "rb").read())
    assert np.array_equal(r.values[0], c.to_array()[0, 1])
    assert sinks.write_png_collection(c, f"{tmp_path}/p", low=[0], high=[235]) == 3
    assert open(f"{tmp_path}/p/2018-01-01.png", "rb").read().startswith(b"\x89PNG")
    assert sinks.write_chunks(c, f"{tmp_path}/c", "netcdf", (2, 4, 4)) == 4
    assert netcdf.Reader(open(f"{tmp_path}/c/3.nc", "rb").read()).values("v").shape == (1, 4, 2)
    assert sinks.write_chunks(c, f"{tmp_path}/g", "gtiff", (2, 4, 4), chunks=[0]) == 2
    sinks.write_cube(c, f"{tmp_path}/cube")
    assert np.array_equal(sources.read_cube(spark, f"{tmp_path}/cube").to_array(), c.to_array())


def collection(spark, tmp_path):
    for day, shift in ((1, 0), (2, 100), (2, 500)):
        for band in (1, 2):
            v = (np.arange(24).reshape(1, 4, 6) + shift + 1000 * band).astype("i4")
            v[0, 0, 0] = -1 if shift == 500 else v[0, 0, 0]
            path = tmp_path / f"im_2018010{day}_{shift}_B{band}.tif"
            path.write_bytes(geotiff.write(geotiff.Raster(v, 0.0, 4.0, 1.0, 1.0, "EPSG:3857", -1.0)))
    names = sorted(str(p) for p in tmp_path.glob("im_*.tif"))
    files = spark.createDataFrame([(n, 0.0, 1e-4, 0.0, 1e-4, "EPSG:3857") for n in [*names, "/else/readme.txt"]], "descriptor string, left double, right double, bottom double, top double, proj string")
    rules = {"pattern": r".*\.tif", "images": {"pattern": r".*/(im_.*)_B\d\.tif"}, "datetime": {"pattern": r".*_(\d{8})_.*", "format": "%Y%m%d"}, "bands": {f"B{b}": {"pattern": rf".*_B{b}\.tif", "type": "int32"} for b in (1, 2)}}
    return ImageCollection.create(files, rules)


def test_collection(spark, tmp_path):
    c = collection(spark, tmp_path)
    assert c.counts() == {"images": 3, "bands": 2, "refs": 6}
    assert not c.is_empty() and c.is_aligned() and c.distinct_srs() == "EPSG:3857" and c.pixel_size_bytes() == 8
    assert c.filter_bands(["B2"]).refs.count() == 3
    assert c.filter_datetime_range("2018-01-02", "2018-01-05").counts()["refs"] == 4
    assert c.filter_spatial_range(5, 6, 5, 6).is_empty()
    assert [r["image_count"] for r in c.all_bands().collect()] == [3, 3]
    assert c.default_view().ref.time.nt >= 1
    c.write(f"{tmp_path}/cat")
    assert ImageCollection.read(spark, f"{tmp_path}/cat").counts() == c.counts()
    assert time_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"


@pytest.mark.parametrize(("how", "corner", "other"), [("first", 1100, 1101), ("last", 1100, 1501), ("none", None, 1501), ("min", 1100, 1101), ("max", 1100, 1501), ("mean", 1100, 1301), ("median", 1100, 1301), ("count_values", 1, 2), ("count_images", 2, 2)])
def test_image_scan(spark, tmp_path, how, corner, other):
    view = CubeView(R, "near", how)
    a = collection(spark, tmp_path).cube(view, ["B1"]).to_array()[0]
    assert a[1, 0, 1] == other
    assert np.isnan(a[1, 0, 0]) if corner is None else a[1, 0, 0] == corner
    assert np.isnan(a[2]).all()


def test_presets(spark):
    names = ["/d/S2A_MSIL2A_20180510T101031_N0207_R022.SAFE/GRANULE/x/IMG_DATA/R10m/T32_B02_10m.jp2", "/d/S2A_MSIL2A_20180510T101031_N0207_R022.SAFE/GRANULE/x/IMG_DATA/R20m/T32_SCL_20m.jp2", "/d/other.txt"]
    c = ImageCollection.create(spark.createDataFrame([(n,) for n in names], "descriptor string"), "sentinel2_l2a")
    row = c.images.first()
    assert (row["name"], str(row["datetime"])) == ("S2A_MSIL2A_20180510T101031_N0207_R022", "2018-05-10 10:10:31")
    assert [r["name"] for r in c.available_bands().collect()] == ["B02", "SCL"]
    bad = spark.createDataFrame([("/d/x.SAFE/IMG_DATA/a.jp2",)], "descriptor string")
    assert ImageCollection.create(bad, "sentinel2_l1c", strict=False).images.count() == 0
    with pytest.raises(Exception, match="no image name or time"):
        ImageCollection.create(bad, "sentinel2_l1c").images.collect()
    with pytest.raises(ValueError, match="no collection format"):
        ImageCollection.create(bad, "nope")


def test_resampling(spark, tmp_path):
    c = collection(spark, tmp_path)
    fine = CubeRef.create(0, 6, 0, 4, nx=12, ny=8, srs="EPSG:3857", t0="2018-01-01", t1="2018-01-01", dt="P1D")
    near = c.cube(CubeView(fine, "near", "first"), ["B1"]).to_array()[0, 0]
    assert np.array_equal(near, np.kron(np.arange(24).reshape(4, 6) + 1000, np.ones((2, 2))))
    coarse = CubeRef.create(0, 6, 0, 4, nx=3, ny=2, srs="EPSG:3857", t0="2018-01-01", t1="2018-01-01", dt="P1D")
    assert c.cube(CubeView(coarse, "average", "first"), ["B1"]).to_array()[0, 0, 0, 0] == 1003.5
    for kernel in ("bilinear", "cubic", "cubicspline", "lanczos"):
        a = c.cube(CubeView(fine, kernel, "first"), ["B1"]).to_array()[0, 0]
        assert abs(a[3, 5] - (1000 + 2.25 + 6 * 1.25)) < 0.3
    with pytest.raises(ValueError):
        c.cube(CubeView(fine, "magic", "first"), ["B1"])


def test_simple_cube_plan(spark, tmp_path):
    collection(spark, tmp_path)
    plan = {"cube_type": "simple_cube", "files": [f"{tmp_path}/im_20180101_0_B1.tif", f"{tmp_path}/im_20180102_100_B1.tif"], "datetime": ["2018-01-01", "2018-01-02"], "band_names": ["q"]}
    c = Cube.from_json(spark, plan)
    assert c.bands == ("q",) and c.ref.nt == 2 and c.to_array()[0, 1, 3, 5] == 1123
    assert Cube.from_json(spark, {"cube_type": "reduce_time", "reducer_bands": [["sum", "q"]], "in_cube": plan}).to_array()[0, 0, 0, 1] == 2102


def test_command_line(spark, tmp_path, capsys):
    view = CubeView(R).to_json()
    (tmp_path / "plan.json").write_text(json.dumps({"cube_type": "dummy", "view": view, "nbands": 1, "fill": 4}))
    assert cli.main(["exec", str(tmp_path / "plan.json"), f"{tmp_path}/o.nc"], spark) == 0
    assert sources.from_netcdf(spark, f"{tmp_path}/o.nc").to_array().mean() == 4
    collection(spark, tmp_path).write(f"{tmp_path}/cat")
    assert cli.main(["info", f"{tmp_path}/cat"], spark) == 0
    assert json.loads(capsys.readouterr().out)["images"] == 3


def test_stream(spark, tmp_path):
    rows = [("2018-01-01 00:10:00", 0.5, 3.5, 1.0), ("2018-01-01 00:50:00", 0.5, 3.5, 3.0), ("2018-01-01 01:10:00", 0.5, 3.5, float("nan")), ("2018-01-01 01:20:00", 9.0, 3.5, 3.0)]
    spark.createDataFrame(rows, "t string, x double, y double, v double").withColumn("t", F.col("t").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("t timestamp, x double, y double, v double").parquet(f"{tmp_path}/in")
    out = aggregate_stream(stream_cells(source, R, x=F.col("x"), y=F.col("y"), t=F.col("t"), bands={"v": F.col("v")}), ["v"], "PT1H", "mean")
    q = out.writeStream.format("memory").queryName("agg").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted((r["t0"].hour, r["v"] or -1) for r in spark.table("agg").collect()) == [(0, 2.0), (1, -1)]
    finally:
        q.stop()
    with pytest.raises(ValueError):
        aggregate_stream(source, ["v"], "P1M")
