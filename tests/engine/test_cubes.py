"""Hand-computed cubes, with holes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.cube import Cube, cells
from lattix.functions.expressions import compile_expression
from lattix.operators.join import join_bands
from lattix.operators.pixel import RangeMask, ValueMask
from lattix.ref import CubeRef, CubeView
from lattix.sinks import Packing, pack
from lattix.sources import basic

C1 = [[3.0, None, 1.0, 1.0], [None, None, None, None]]


def ref(nt, ny=1, nx=2):
    return CubeRef.create(0, nx, 0, ny, nx=nx, ny=ny, srs="EPSG:3857", t0="2018-01-01", t1=f"2018-01-{nt:02}", dt="P1D")


def series(spark, values, drop_missing=False):
    rows = [(t, 0, x, v) for x, s in enumerate(values) for t, v in enumerate(s) if not (drop_missing and v is None)]
    df = spark.createDataFrame(rows, "it int, iy int, ix int, v double")
    return cells(df, ref(len(values[0]), nx=len(values)), ["v"])


def values(cube, band=None, ix=0):
    band = band or cube.bands[0]
    got = {r["it"]: r[band] for r in cube.df.where(F.col("ix") == ix).collect()}
    return [None if got.get(t) is None else round(got[t], 4) for t in range(cube.ref.nt)]


@pytest.mark.parametrize(("func", "a", "b"), [("sum", 5, 0), ("prod", 3, 1), ("count", 3, 0), ("mean", 1.6667, None), ("min", 1, None), ("max", 3, None), ("median", 1, None), ("var", 1.3333, None), ("sd", 1.1547, None), ("Q1", 1, None), ("q3", 2, None), ("which_min", 20180103, None), ("which_max", 20180101, None)])
def test_reduce_time(spark, func, a, b):
    c = series(spark, C1).reduce_time([(func, "v")])
    assert (values(c, ix=0), values(c, ix=1)) == ([a], [b])


def test_quantiles(spark):
    c = series(spark, [[1.0, 2.0, 3.0, 10.0]]).reduce_time([("Q1", "v"), ("Q3", "v"), ("var", "v"), ("median", "v"), ("prod", "v")])
    assert [values(c, b)[0] for b in c.bands] == [1.75, 4.75, 16.6667, 2.5, 60]


def test_reduced_again(spark):
    c = series(spark, C1).reduce_time([("sum", "v"), ("count", "v")])
    assert c.reduce_time([("mean", "v_count")]).bands == ("v_count",)


@pytest.mark.parametrize(("func", "a", "b"), [("mean", [3, 1], [None, None]), ("sum", [3, 2], [None, None]), ("count", [1, 2], [0, 0])])
def test_aggregate_time(spark, func, a, b):
    c = series(spark, C1).aggregate_time("P2D", func)
    assert (values(c, ix=0), values(c, ix=1)) == (a, b)


def test_months_of_a_year(spark):
    r = CubeRef.create(-6180000, -6080000, -550000, -450000, dx=50000, dy=50000, srs="EPSG:3857", t0="2014-01-01", t1="2014-12-31", dt="P1D")
    c = basic.dummy(spark, r, 1, 1.0).aggregate_time("P1M", "mean")
    assert c.ref.nt == 12
    assert [tuple(x) for x in c.df.select("band1").distinct().collect()] == [(1.0,)]


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize(("kind", "want"), [("mean", [3, 2, 1, 1]), ("count", [1, 2, 2, 2]), ("sum", [3, 4, 2, 2]), ("max", [3, 3, 1, 1]), ("median", [3, 2, 1, 1])])
def test_window_time(spark, kind, want, sparse):
    c = series(spark, C1[:1], sparse).window_time([(kind, "v")], left=1, right=1)
    assert values(c) == want


def test_window_without_values(spark):
    c = series(spark, C1).window_time([("count", "v"), ("sum", "v"), ("prod", "v"), ("min", "v")], left=1, right=1)
    assert [values(c, b, 1) for b in c.bands] == [[0] * 4, [0] * 4, [1] * 4, [None] * 4]


def test_kernel(spark):
    assert values(series(spark, [[1.0, 4.0, 9.0, 16.0]]).window_time(kernel=[-1, 2, -1])) == [None, -2, -2, None]
    assert values(series(spark, C1).window_time(kernel=[-1, 2, -1])) == [None] * 4
    with pytest.raises(ValueError, match="3 weights"):
        series(spark, C1).window_time(kernel=[1, 2])


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize(("method", "want"), [("linear", [2, 2, 4, 6, 8, 8]), ("near", [2, 2, 2, 8, 8, 8]), ("locf", [None, 2, 2, 2, 8, 8]), ("nocb", [2, 2, 8, 8, 8, None])])
def test_fill_time(spark, method, want, sparse):
    c = series(spark, [[None, 2.0, None, None, 8.0, None]], sparse)
    assert values(c.fill_time(method)) == want
    assert values(c.fill_time(method).fill_time(method)) == want


def test_crop_beyond_the_cube(spark):
    c = series(spark, C1).crop(ix=(-1, 1))
    assert (c.ref.nx, c.ref.left) == (3, -1)
    assert values(c, ix=0) == [None] * 4 and values(c, ix=1)[0] == 3
    assert c.crop(ix=(1, 0)).ref.nx == 2
    with pytest.raises(ValueError, match="outside"):
        c.crop(ix=(5, 9))


def test_slices(spark):
    c = series(spark, C1)
    assert values(c.slice_time("2018-01-03")) == [1]
    assert str(c.slice_time(3).ref.time.t0) == "2018-01-04"
    assert values(c.select_time(["2018-01-04", "2018-01-01", "2019-01-01"])) == [3, 1]
    assert values(c.slice_space(x=0.5, y=0.5)) == [3, None, 1, 1]
    for bad in (lambda: c.slice_time(9), lambda: c.slice_space(5, 0), lambda: c.select_time(["2020-01-01"])):
        with pytest.raises(ValueError):
            bad()


def test_labelled_time(spark):
    c = series(spark, [[1.0, 2.0, 3.0, 4.0]]).select_time(["2018-01-01", "2018-01-02", "2018-01-04"])
    assert values(c.reduce_time([("which_max", "v")])) == [20180104]
    assert values(c.aggregate_time("P2D", "sum")) == [3, 4]
    assert values(c.apply_pixel("t1 - t0")) == [86400, 2 * 86400, None]
    assert c.slice_time("2018-01-04").df.count() == 1
    with pytest.raises(ValueError):
        c.slice_time("2018-01-03")


def test_pixel_operators(spark):
    c = series(spark, C1)
    assert values(c.filter_pixel("v < 3")) == [None, None, 1, 1]  # a missing value is kept, and is missing
    assert values(c.filter_pixel("v > 100").reduce_time([("count", "v")])) == [0]
    both = c.apply_pixel(["v * 2", "it + ix"], keep_bands=True)
    assert both.bands == ("v", "x1", "x2")
    assert values(both, "x1") == [6, None, 2, 2] and values(both, "x2", 1) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="unknown variable"):
        c.apply_pixel("w + 1")
    assert c.rename_bands({"v": "w"}).bands == ("w",)
    with pytest.raises(ValueError):
        c.select_bands(["nope"])


@pytest.mark.parametrize(("text", "want"), [("2^3^2", 64), ("-2^2", -4), ("1 + 2 * 3 % 2", 1), ("1/0", None), ("sqrt(0-1)", None), ("ncr(5,2)", 10), ("npr(5,2)", 20), ("fac(5)", 120), ("log(100) + ln(e)", 3), ("1 < 2 && !(3 == 4)", 1), ("1 / 0 > 1", 0), ("1/0 != 1", 1), ("isnan(1/0)", 1), ("iif(2 > 1, 5, 6)", 5), ("atan2(0, 1) + pi * 0", 0), ("5 % 0", None), ("1e3 + .5", 1000.5)])
def test_expressions(spark, text, want):
    got = spark.range(1).select(compile_expression(text, {}).alias("x")).first()[0]
    assert got == want if want is None else got == pytest.approx(want)


@pytest.mark.parametrize("text", ["1 +", "foo(1)", "(1", "1 2", "sqrt(1, 2)", "a $ b"])
def test_bad_expressions(text):
    with pytest.raises(ValueError):
        compile_expression(text, {})


def test_masks(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0, 4.0), (1, 0, 0, 2.0, 6.0), (2, 0, 0, 3.0, None)], "it int, iy int, ix int, v double, m double")
    c = cells(df, ref(3), ["v", "m"])
    assert values(c.mask("m", ValueMask((4.0,))), "v") == [None, 2, 3]
    assert values(c.mask("m", ValueMask((4.0,), invert=True)), "v") == [1, None, 3]
    assert values(c.mask("m", ValueMask((2.0,), bits=(1,))), "v") == [1, None, 3]
    assert values(c.mask("m", RangeMask(4, 5)), "v") == [None, 2, 3]
    assert values(c.mask("m", RangeMask(4, 5, invert=True)), "v") == [1, None, 3]


def test_join(spark):
    a, b = series(spark, [[1.0, None]], True), series(spark, [[None, 5.0]], True)
    j = join_bands([a, b])
    assert j.bands == ("X1.v", "X2.v")
    assert values(j, "X1.v") == [1, None] and values(j, "X2.v") == [None, 5]
    with pytest.raises(ValueError):
        join_bands([a, b], ["A", "A"])
    with pytest.raises(ValueError, match="grid"):
        join_bands([a, series(spark, [[1.0, 2.0, 3.0]])])


def test_packing(spark):
    p = pack(series(spark, [[2.25, None]]), Packing("uint8", (0.5,), (1.0,), (255.0,)))
    assert sorted(r["v"] for r in p.collect()) == [3, 255]
    with pytest.raises(ValueError):
        Packing("int7")


def test_nan_is_missing(spark):
    c = cells(spark.createDataFrame([(0, 0, 0, float("nan")), (1, 0, 0, 2.0)], "it int, iy int, ix int, v double"), ref(2), ["v"])
    assert values(c.reduce_time([("max", "v")])) == [2]


def test_aggregate_space_centres(spark):
    c = basic.dummy(spark, ref(1, ny=4, nx=6), 1, 2.0)
    s = c.aggregate_space(4, 4, "count")
    assert (s.ref.nx, s.ref.left) == (2, -1)
    assert sorted((r["ix"], r["band1"]) for r in s.df.collect()) == [(0, 12.0), (1, 12.0)]


def test_names(spark):
    with pytest.raises(ValueError, match="repeat"):
        series(spark, C1).apply_pixel(["1"], ["v"], keep_bands=True)
    with pytest.raises(ValueError, match="unknown function"):
        series(spark, C1).reduce_time([("average", "v")])


def test_plan_round_trip(spark):
    view = CubeView(ref(4)).to_json()
    c = Cube.from_json(spark, {"cube_type": "dummy", "view": view, "nbands": 2, "fill": 3})
    c = c.select_bands(["band2"]).apply_pixel("band2 + it", ["q"]).crop(it=(1, 3)).window_time([("mean", "q")], left=1, right=0).fill_time("locf").filter_pixel("q_mean > 4").aggregate_time("P3D", "max").reduce_space([("max", "q_mean")])
    again = Cube.from_json(spark, c.to_json())
    assert again.bands == c.bands and again.ref == c.ref
    assert np.array_equal(again.to_array(), c.to_array(), equal_nan=True)
    with pytest.raises(ValueError, match="unknown cube type"):
        Cube.from_json(spark, {"cube_type": "nope"})
