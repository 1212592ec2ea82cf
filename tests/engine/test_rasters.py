"""Reference systems, tiled and compressed GeoTIFF, and product naming rules."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix import crs
from lattix.ref import CubeRef, CubeView
from lattix.sources import geotiff
from lattix.sources.catalog import ImageCollection


def test_utm_points():
    x, y = crs.transform_point(2.2945, 48.8582, "EPSG:4326", "EPSG:32631")
    assert abs(x - 448251.8) < 1 and abs(y - 5411932.7) < 1
    assert crs.transform_point(9.0, 0.0, "EPSG:4326", "EPSG:32632") == pytest.approx((500_000, 0), abs=1e-6)
    for lon, lat, code in ((7.3, 51.2, 32632), (11.9, -33.0, 32732), (-70.1, -0.5, 32719), (179.9, 80.0, 32660)):
        there = crs.transform_point(lon, lat, "EPSG:4326", f"EPSG:{code}")
        assert crs.transform_point(*there, f"EPSG:{code}", "EPSG:4326") == pytest.approx((lon, lat), abs=1e-8)
    # the scale along the central meridian is 0.9996 of the meridian's arc
    north = crs.transform_point(9.0, 1.0, "EPSG:4326", "EPSG:32632")[1]
    assert north / 0.9996 == pytest.approx(110574.38, abs=1)
    with pytest.raises(NotImplementedError):
        crs.transform_point(1, 1, "EPSG:2154", "EPSG:4326")


def test_points_arrays_and_columns_agree(spark):
    for code, x, y in ((32632, 412_345.0, 5_400_000.0), (32733, 700_000.0, 8_000_000.0), (3857, 1e6, -2e6)):
        want = crs.transform_point(x, y, f"EPSG:{code}", "EPSG:4326")
        assert crs.transform_arrays(np.array([x]), np.array([y]), f"EPSG:{code}", "EPSG:4326") == (pytest.approx([want[0]]), pytest.approx([want[1]]))
        lon, lat = crs.transform_columns(F.lit(x), F.lit(y), f"EPSG:{code}", "EPSG:4326")
        back = crs.transform_columns(F.col("lon"), F.col("lat"), "EPSG:4326", f"EPSG:{code}")
        row = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).select("lon", "lat", back[0].alias("x"), back[1].alias("y")).first()
        assert tuple(row) == pytest.approx((*want, x, y), abs=1e-3)


def test_images_in_several_zones(spark, tmp_path):
    """A field of longitudes in two zones and in degrees, put on one grid."""
    paths = []
    for k, (code, lon) in enumerate(((32631, 4.0), (32632, 8.0), (4326, 10.003))):
        left, top = crs.transform_point(lon, 50.503, "EPSG:4326", f"EPSG:{code}")
        step = 2_000.0 if code != 4326 else 0.02
        v = np.empty((1, 30, 30), "f4")
        for i in range(30):
            for j in range(30):
                v[0, i, j] = crs.transform_point(left + (j + 0.5) * step, top - (i + 0.5) * step, f"EPSG:{code}", "EPSG:4326")[0]
        path = tmp_path / f"z{k}.tif"
        path.write_bytes(geotiff.write(geotiff.Raster(v, left, top, step, step, f"EPSG:{code}", None)))
        paths.append(str(path))
    c = ImageCollection.create_with_times(spark, paths, ["2020-01-01"] * 3, ["lon"])
    ref = CubeRef.create(4.0, 10.6, 49.95, 50.45, dx=0.02, dy=0.02, srs="EPSG:4326", t0="2020-01-01", t1="2020-01-01", dt="P1D")
    a = c.cube(CubeView(ref, "near", "mean"), ["lon"]).to_array()[0, 0]
    centre = ref.left + (np.arange(ref.nx) + 0.5) * ref.dx
    for low, high in ((4.2, 4.6), (8.2, 8.6), (10.1, 10.5)):
        cells = (centre > low) & (centre < high)
        assert np.nanmax(np.abs(a[5:20, cells] - centre[cells])) < 0.03
        assert not np.isnan(a[5:20, cells]).any(), (low, np.argwhere(np.isnan(a[5:20, cells])).tolist()[:60])


def lzw_pack(data):
    """Codes of 9 to 12 bits, widened one early, as the format says."""
    out, bits, have = bytearray(), 0, 0
    table, width = {bytes([i]): i for i in range(256)}, 9

    def put(code):
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)

    put(256)
    word = b""
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = len(table) + 2
        n = len(table) + 2
        if n == 4095:
            put(256)
            table, width = {bytes([k]): k for k in range(256)}, 9
        elif n in (512, 1024, 2048):
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def tiff(values, tile, packed, predictor, apart=False, order="<"):
    """A file of tiles, or of strips with ``tile`` as (rows, None)."""
    bands, height, width = values.shape
    th, tw = tile[0], tile[1] or width
    kind = values.dtype.newbyteorder(order)
    blocks = []
    for layer in range(bands if apart else 1):
        part = values[layer : layer + 1] if apart else values
        for y in range(0, height, th):
            for x in range(0, width, tw):
                rows = th if tile[1] else min(th, height - y)
                block = np.zeros((rows, tw, len(part)), values.dtype)
                cut = part[:, y : y + rows, x : x + tw].transpose(1, 2, 0)
                block[: cut.shape[0], : cut.shape[1]] = cut
                if predictor == 2:
                    block[:, 1:] = block[:, 1:] - block[:, :-1]
                if predictor == 3:
                    n, size = block.shape[2], values.dtype.itemsize
                    planes = block.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, tw * n, size).transpose(0, 2, 1).reshape(rows, -1, n)
                    planes = planes.copy()
                    planes[:, 1:] = planes[:, 1:] - planes[:, :-1]
                    raw = planes.tobytes()
                else:
                    raw = block.astype(kind).tobytes()
                blocks.append({1: bytes, 5: lzw_pack, 8: zlib.compress}[packed](raw))
    form = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    fields = {256: (4, [width]), 257: (4, [height]), 258: (3, [values.dtype.itemsize * 8] * bands), 259: (3, [packed]), 277: (3, [bands]), 284: (3, [2 if apart else 1]), 317: (3, [predictor]), 339: (3, [form] * bands), 33550: (12, [2.0, 3.0, 0.0]), 33922: (12, [0, 0, 0, 10.0, 20.0, 0])}
    fields |= {322: (3, [tw]), 323: (3, [th]), 324: (4, [0] * len(blocks)), 325: (4, list(map(len, blocks)))} if tile[1] else {273: (4, [0] * len(blocks)), 278: (3, [th]), 279: (4, list(map(len, blocks)))}
    letters = {3: "H", 4: "I", 12: "d"}
    head = 8 + 2 + 12 * len(fields) + 4
    size = lambda k, v: struct.calcsize(f"<{len(v)}{letters[k]}")
    at = head + sum(size(k, v) for k, v in fields.values() if size(k, v) > 4)
    places = []
    for b in blocks:
        places.append(at)
        at += len(b)
    fields[324 if tile[1] else 273] = (4, places)
    entries, extra = b"", b""
    for tag in sorted(fields):
        k, v = fields[tag]
        raw = struct.pack(f"{order}{len(v)}{letters[k]}", *v)
        entries += struct.pack(f"{order}HHI", tag, k, len(v))
        entries += struct.pack(f"{order}I", head + len(extra)) if len(raw) > 4 else raw.ljust(4, b"\0")
        extra += raw if len(raw) > 4 else b""
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HIH", 42, 8, len(fields)) + entries + bytes(4) + extra + b"".join(blocks)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("kind", "predictor"), [("u1", 1), ("u2", 2), ("i4", 2), ("f4", 1), ("f4", 3), ("f8", 3)])
@pytest.mark.parametrize("packed", [1, 5, 8])
def test_tiles_and_compression(kind, predictor, packed, order):
    r = np.random.default_rng(4)
    smooth = np.add.outer(np.arange(75), np.arange(53))[None] * np.array([1, 2, 3])[:, None, None] + r.integers(0, 3, (3, 75, 53))
    values = (smooth % 251).astype(kind)
    for tile in ((16, 32), (64, 64), (10, None), (75, None)):
        for apart in (False, True):
            got = geotiff.read(tiff(values, tile, packed, predictor, apart, order))
            assert np.array_equal(got.values, values) and (got.left, got.top, got.dx, got.dy) == (10, 20, 2, 3)


def test_lzw_of_long_data():
    r = np.random.default_rng(2)
    for data in (b"", b"a", b"a" * 9000, r.integers(0, 256, 30_000, np.uint8).tobytes(), r.integers(0, 3, 60_000, np.uint8).tobytes()):
        assert geotiff.lzw(lzw_pack(data)) == data


@pytest.mark.parametrize(
    ("preset", "path", "name", "time", "band"),
    [
        ("chirps_daily", "/d/chirps-v2.0.2018.03.05.tif", "chirps-v2.0.2018.03.05", "2018-03-05 00:00:00", "precipitation"),
        ("chirps_monthly", "/d/chirps-v2.0.2018.03.tif", "chirps-v2.0.2018.03", "2018-03-01 00:00:00", "precipitation"),
        ("landsat8_l1tp", "/d/LC08_L1TP_195025_20180305_20180319_01_T1/LC08_L1TP_195025_20180305_20180319_01_T1_B5.TIF", "LC08_L1TP_195025_20180305_20180319_01_T1", "2018-03-05 00:00:00", "B05"),
        ("landsat8_sr", "x/LC08_L1TP_195025_20180305_20180319_01_T1_sr_band4.tif", "LC08_L1TP_195025_20180305_20180319_01_T1", "2018-03-05 00:00:00", "B04"),
        ("planetscope_sr", "/d/20180305_101112_0f3c_3B_AnalyticMS_DN_udm.tif", "20180305_101112_0f3c_3B", "2018-03-05 00:00:00", "udm"),
        ("sentinel1_grd", "/d/S1A_IW_GRDH_1SDV_20180305T053944_20180305T054009_020873_023D0E_D7B2.SAFE/measurement/s1a-iw-grd-vh-20180305t053944-20180305t054009-020873-023d0e-002.tiff", "S1A_IW_GRDH_1SDV_20180305T053944_20180305T054009_020873_023D0E_D7B2", "2018-03-05 05:39:44", "VH"),
        ("sentinel2_l1c", "/d/S2B_MSIL1C_20180305T103019_N0206_R108_T32UMC_20180305T123456.SAFE/GRANULE/L1C_T32UMC/IMG_DATA/T32UMC_20180305T103019_B8A.jp2", "S2B_MSIL1C_20180305T103019_N0206_R108_T32UMC_20180305T123456", "2018-03-05 10:30:19", "B8A"),
        ("sentinel2_theia", "/d/SENTINEL2A_20180305-105030-123_L2A_T31TCJ_D_V1-4/SENTINEL2A_20180305-105030-123_L2A_T31TCJ_D_V1-4_FRE_B11.tif", "SENTINEL2A_20180305-105030-123_L2A_T31TCJ_D_V1-4", "2018-03-05 10:50:30", "B11"),
    ],
)
def test_naming_rules(spark, preset, path, name, time, band):
    files = spark.createDataFrame([(path,), ("/d/readme.txt",)], "descriptor string")
    c = ImageCollection.create(files, preset)
    row = c.images.collect()
    assert [(r["name"], str(r["datetime"])) for r in row] == [(name, time)]
    assert band in [r["name"] for r in c.available_bands().collect()]
