import pytest

from lattix.ref import CubeRef, CubeView
from lattix.timeaxis import Duration, RegularTime, Time, Unit


@pytest.mark.parametrize(
    ("t0", "t1", "dt", "want"),
    [
        ("2018-01-01", "2018-01-10", "P3D", ("2018-01-01", "2018-01-12", 4)),
        ("2018-01-01", "2018-02-10", "P3M", ("2018-01-01", "2018-03-31", 1)),
        ("2018-01-01", "2018-02-10", "P1Y", ("2018-01-01", "2018-12-31", 1)),
        ("2018-01", "2018-02", "P2Y", ("2018-01-01", "2019-12-31", 1)),
        ("2018", "2018", "P1D", ("2018-01-01", "2018-12-31", 365)),
        ("2014-01-01", "2014-12-31", "P1M", ("2014-01-01", "2014-12-31", 12)),
    ],
)
def test_axis_by_duration(t0, t1, dt, want):
    a = RegularTime.by_duration(t0, t1, dt)
    assert (str(a.t0), str(a.t1), a.nt) == want


def test_axis_by_count():
    a = RegularTime.by_count("2018-01-01", "2018-01-10", 10)
    assert a.nt == 10 and str(a.dt) == "P1D"
    b = RegularTime.by_count("2018-03-26T09:40:29", "2018-11-08T09:32:09", 4)
    assert (b.t1 - b.t0).count > 0


@pytest.mark.parametrize(("text", "unit"), [("2002-03-04 12:13:14", Unit.SECOND), ("2002-03-04 12:13", Unit.MINUTE), ("2002-03-04T12", Unit.HOUR), ("2002-03-04", Unit.DAY), ("2002-03", Unit.MONTH), ("2002", Unit.YEAR), ("2021-06-29T10:03:38.494534Z", Unit.SECOND), ("2021-06-29T10:03:38.494534+01:00", Unit.SECOND)])
def test_units(text, unit):
    assert Time.parse(text).unit == unit


def test_arithmetic():
    t = Time.parse("2002-03-04")
    assert str(t + Duration.parse("P5D")) == "2002-03-09"
    assert str(Duration.parse("P5D") * 5) == "P25D"
    assert str(Time.parse("2002-03-10") - t) == "P6D"
    assert t.number() == 20020304
    m = Time.parse("2002-03") + Duration.parse("P3M")
    assert str(m) == "2002-06-01" and m.unit == Unit.MONTH and m.number() == 200206
    assert str(Time.parse("2021-01-31") + Duration.parse("P3M")) == "2021-04-30"
    assert (Time.parse("2001-03-01").day_of_year, Time.parse("2000-03-01").day_of_year) == (60, 61)
    assert Time.parse("2002-03-04T13:40:21").day_of_week == 1
    assert Time.from_digits("20020304").unit == Unit.DAY
    for bad in ("P", "P5", "5D", "PT3D", "P3H"):
        with pytest.raises(ValueError):
            Duration.parse(bad)


def test_space_axis():
    r = CubeRef.create(-110, 110, -50, 50, dx=0.5, ny=200, t0="2018", t1="2018", dt="P1M")
    assert (r.nx, r.left, r.right, r.dy) == (440, -110, 110, 0.5)
    r = CubeRef.create(0, 10, 0, 10, dx=3, dy=5, t0="2018", t1="2018", dt="P1M")
    assert (r.nx, r.left, r.right) == (4, -1, 11)


def test_view_json():
    v = CubeView.from_json({"space": {"left": 0, "right": 4, "bottom": 0, "top": 2, "nx": 4, "srs": "EPSG:3857"}, "time": {"t0": "2018-01-01", "t1": "2018-01-04", "dt": "P1D"}})
    assert (v.ref.ny, v.aggregation, v.resampling) == (2, "none", "near")
    assert CubeView.from_json(v.to_json()) == v
    tile = CubeView.from_json({"tile": {"x": 1, "y": 0, "z": 1}, "time": {"t0": "2018", "t1": "2018", "dt": "P1M"}})
    assert tile.ref.left == 0 and tile.ref.bottom == 0 and tile.ref.nx == 256
