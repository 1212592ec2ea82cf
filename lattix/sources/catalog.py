"""Image collections: a catalog of images, bands and references, and scans of them.

The catalog is six DataFrames. Deleting bands or images cascades by semi joins. Image
extents are in geographic degrees. Frames are immutable: every operation returns a new
collection.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..crs import transform_arrays, transform_bounds
from ..cube import KEYS, Cube
from ..functions.aggregates import aggregate_column, clean
from ..operators.pixel import RangeMask, ValueMask, mask_condition
from ..ref import CubeRef, CubeView
from ..timeaxis import Duration, RegularTime, Time, Unit, parse_time
from .basic import time_bounds
from .geotiff import read as read_tiff
from .presets import PRESETS
from .resample import resample

SCHEMAS = {
    "images": "id long, name string, left double, top double, bottom double, right double, datetime timestamp_ntz, proj string",
    "bands": "id long, name string, type string, offset double, scale double, unit string, nodata string",
    "refs": "image_id long, band_id long, descriptor string, band_num int",
    "image_md": "image_id long, key string, value string",
    "band_md": "band_id long, key string, value string",
    "collection_md": "key string, value string",
}
STEPS = 10  # of the search for a name's range: 2 ** STEPS ranges
BYTES = {"int16": 2, "uint16": 2, "int32": 4, "uint32": 4, "uint8": 1, "float32": 4, "float64": 8}
ORDERS = ("images.name", "images.datetime", "bands.name", "refs.descriptor", "images.id")
AGGREGATIONS = ("none", "min", "max", "mean", "median", "first", "last", "count_images", "count_values")
#: Strptime directives and the patterns of Spark for them.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "y": "yy", "b": "MMM", "B": "MMMM"}


def time_pattern(strptime: str) -> str:
    """A strptime format as a pattern of Spark."""
    out, at = "", 0
    while at < len(strptime):
        ch = strptime[at]
        if ch == "%":
            at += 1
            if strptime[at] not in DIRECTIVES:
                raise ValueError(f"unknown directive %{strptime[at]}")
            out += DIRECTIVES[strptime[at]]
        else:
            out += f"'{ch}'" if ch.isalpha() else ch
        at += 1
    return out


def load_format(value: str | dict) -> dict[str, Any]:
    """Rules as a dictionary, JSON text, a file, the name of a file on ``LATTIX_FORMATS``, or a preset's name."""
    if isinstance(value, dict):
        return value
    if value.lstrip().startswith("{"):
        return json.loads(value)
    for folder in ("", *os.environ.get("LATTIX_FORMATS", "").split(os.pathsep)):
        for path in (os.path.join(folder, value), os.path.join(folder, f"{value}.json")):
            if os.path.isfile(path):
                with open(path, encoding="utf-8") as file:
                    return json.load(file)
    if value in PRESETS:
        return PRESETS[value]
    raise ValueError(f"there is no collection format {value!r}; presets are {', '.join(PRESETS)}")


def archive_path(path: str) -> str:
    """The virtual path of a file in an archive's terms: zip, gz and tar files are looked into."""
    for ends, prefix in (((".tar.gz", ".tgz", ".tar"), "/vsitar/"), ((".zip",), "/vsizip/"), ((".gz",), "/vsigzip/")):
        if path.lower().endswith(ends):
            return prefix + path
    return path


def numbered(names: DataFrame) -> DataFrame:
    """Each different ``name`` with its place in their order as ``id``, from 1; no task gets all names.

    Pivots, the names of smallest hash, cut the order into ranges. A name's place is that
    in its range, behind the counts of the ranges before.
    """
    different = names.distinct()
    pivots = different.orderBy(F.xxhash64("name"), "name").limit(2**STEPS - 1).agg(F.sort_array(F.collect_list("name"))).scalar()
    steps = F.array(*[F.lit(2**k) for k in reversed(range(STEPS))])
    search = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_pivots", at + step - 1) <= F.col("name"), at + step).otherwise(at))
    dealt = different.select("name", pivots.alias("_pivots")).select("name", search.alias("_range"))
    # a row a range
    counts = dealt.groupBy("_range").count()
    before = counts.select("_range", (F.sum("count").over(W.orderBy("_range")) - F.col("count")).alias("_before"))
    placed = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_range").orderBy("name"))).join(F.broadcast(before), "_range", "left")
    return placed.groupBy("name").agg(F.min(F.col("_before") + F.col("_at")).alias("id"))


@dataclass(frozen=True)
class ImageCollection:
    images: DataFrame
    bands: DataFrame
    refs: DataFrame
    image_md: DataFrame
    band_md: DataFrame
    collection_md: DataFrame

    # -- making ----------------------------------------------------------------
    @classmethod
    def from_tables(cls, spark: SparkSession, **tables: DataFrame | list) -> ImageCollection:
        """From frames or lists of rows; tables left out are empty."""
        out = {}
        for name, schema in SCHEMAS.items():
            given = tables.get(name)
            out[name] = given if isinstance(given, DataFrame) else spark.createDataFrame(given or [], schema)
        return cls(**out)

    @classmethod
    def create(cls, files: DataFrame, rules: str | dict, strict: bool = True) -> ImageCollection:
        """From file names by rules.

        ``files`` has ``descriptor`` and may have ``left, right, top, bottom`` (degrees),
        ``proj`` and ``metadata`` (a map). Files that the general pattern doesn't match
        are left out; a file whose image name or time can't be read raises when ``strict``
        (at the latest when the table is used), and is left out otherwise.
        """
        rules = load_format(rules)
        spark = files.sparkSession
        path = F.col("descriptor")
        have = {c: F.col(c) if c in files.columns else F.lit(None) for c in ("left", "right", "top", "bottom", "proj", "metadata")}
        known = files.where(path.rlike(rules["pattern"])) if rules.get("pattern") else files
        name = F.regexp_extract(path, rules["images"]["pattern"], 1)
        stamp = F.regexp_extract(path, rules["datetime"]["pattern"], 1)
        when = F.try_to_timestamp(stamp, F.lit(time_pattern(rules["datetime"].get("format", "%Y-%m-%d")))).cast("timestamp_ntz")
        rows = known.select("descriptor", name.alias("name"), when.alias("datetime"), *[have[c].cast("string" if c == "proj" else "double").alias(c) for c in ("left", "right", "top", "bottom", "proj")], have["metadata"].cast("map<string,string>").alias("metadata"))
        rows = rows.withColumn("proj", F.coalesce("proj", F.lit(rules.get("srs"))))
        readable = (F.col("name") != "") & F.col("datetime").isNotNull()
        if strict:
            rows = rows.withColumn("name", F.when(readable, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("no image name or time in "), path))))
        else:
            rows = rows.where(readable)
        own = [(k, b, i + 1) for i, (k, b) in enumerate(rules["bands"].items())]
        bands = spark.createDataFrame([(i, k, b.get("type", "float64"), float(b.get("offset", 0)), float(b.get("scale", 1)), b.get("unit", ""), None if b.get("nodata") is None else str(b["nodata"])) for k, b, i in own], SCHEMAS["bands"])
        matches = F.array_compact(F.array(*[F.when(path.rlike(b.get("pattern", ".*")), F.struct(F.lit(i).cast("long").alias("band_id"), F.lit(int(b.get("band", 1))).alias("band_num"))) for _, b, i in own]))
        rows = rows.withColumn("_bands", matches)
        step = rules["datetime"].get("bands", {}).get("dt") if isinstance(rules["datetime"].get("bands"), dict) else None
        if step:  # band k of a file is the image of time t + k dt
            dt = Duration.parse(step)
            rows = rows.withColumn("_b", F.explode("_bands")).withColumn("datetime", F.timestamp_add(dt.unit.name, (F.col("_b.band_num") - 1) * dt.count, F.col("datetime")))
            rows = rows.withColumn("name", F.concat("name", F.lit("_"), F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss"))).withColumn("_bands", F.array("_b"))
        grouped = rows.groupBy("name").agg(F.min("left").alias("left"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.min("datetime").alias("datetime"), F.min("proj").alias("proj"))
        numbers = numbered(rows.select("name"))
        # every name has a number; by a left join Spark leaves the numbering out where ids aren't asked for
        images = grouped.join(numbers, "name", "left").select("id", "name", "left", "top", "bottom", "right", "datetime", "proj")
        spread = rows.withColumn("_b", F.explode("_bands")).join(numbers, "name")
        refs = spread.groupBy(F.col("id").alias("image_id"), F.col("_b.band_id").alias("band_id")).agg(F.min(F.struct("descriptor", F.col("_b.band_num").alias("band_num"))).alias("r")).select("image_id", "band_id", "r.descriptor", "r.band_num")
        wanted = rules.get("image_md_fields")
        md = rows.join(numbers, "name").select(F.col("id").alias("image_id"), F.explode("metadata").alias("key", "value")).distinct()
        if wanted:
            md = md.where(F.col("key").isin(*wanted, *[w.split(":", 1)[-1] for w in wanted]))
        empty = {k: spark.createDataFrame([], SCHEMAS[k]) for k in ("band_md", "collection_md")}
        return cls(images, bands, refs, md, **empty)

    @classmethod
    def create_with_times(cls, spark: SparkSession, descriptors: list[str], times: list[str], band_names: list[str], one_band_per_file: bool = False, **extent: Any) -> ImageCollection:
        """From listed files and times: a file is an image, or with ``one_band_per_file`` one band of the image of its time."""
        if len(descriptors) != len(times):
            raise ValueError("there must be one time for each file")
        stamp = [parse_time(t).value for t in times]
        bands = [(k + 1, b, "float64", 0.0, 1.0, "", None) for k, b in enumerate(band_names)]
        box = [extent.get(k) for k in ("left", "top", "bottom", "right")]
        if one_band_per_file:
            if len(band_names) != len(descriptors):
                raise ValueError("there must be one band name for each file")
            names = list(dict.fromkeys(band_names))
            bands = [(k + 1, b, "float64", 0.0, 1.0, "", None) for k, b in enumerate(names)]
            order = {t: k + 1 for k, t in enumerate(dict.fromkeys(stamp))}
            images = [(i, f"image_{t.isoformat()}", *box, t, extent.get("proj")) for t, i in order.items()]
            refs = [(order[t], names.index(b) + 1, d, 1) for d, t, b in zip(descriptors, stamp, band_names, strict=True)]
        else:
            images = [(k + 1, os.path.basename(d), *box, t, extent.get("proj")) for k, (d, t) in enumerate(zip(descriptors, stamp, strict=True))]
            refs = [(k + 1, b + 1, d, b + 1) for k, d in enumerate(descriptors) for b in range(len(band_names))]
        return cls.from_tables(spark, images=images, bands=bands, refs=refs)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ImageCollection:
        return cls(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()})

    def write(self, path: str, mode: str = "errorifexists") -> None:
        for name in SCHEMAS:
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    def insert(self, table: str, rows: list | DataFrame) -> ImageCollection:
        """Rows added to a table."""
        old = getattr(self, table)
        new = rows if isinstance(rows, DataFrame) else old.sparkSession.createDataFrame(rows, SCHEMAS[table])
        return replace(self, **{table: old.unionByName(new)})

    # -- restricting -------------------------------------------------------------
    def filter_bands(self, names: list[str]) -> ImageCollection:
        """The named bands only, with what refers to them."""
        if not names:
            raise ValueError("no band is named")
        bands = self.bands.where(F.col("name").isin(*names))
        own = F.broadcast(bands.select(F.col("id").alias("band_id")))  # few, and a shuffle by band would send all files to as many tasks
        return replace(self, bands=bands, refs=self.refs.join(own, "band_id", "left_semi"), band_md=self.band_md.join(own, "band_id", "left_semi"))

    def _with_images(self, images: DataFrame) -> ImageCollection:
        own = images.select(F.col("id").alias("image_id"))
        return replace(self, images=images, refs=self.refs.join(own, "image_id", "left_semi"), image_md=self.image_md.join(own, "image_id", "left_semi"))

    def filter_datetime_range(self, start: str, end: str) -> ImageCollection:
        """Images from ``start`` to ``end``, both included."""
        low, high = parse_time(start).value, parse_time(end).value
        return self._with_images(self.images.where(F.col("datetime").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))))

    def filter_spatial_range(self, left: float, right: float, bottom: float, top: float, srs: str = "EPSG:4326") -> ImageCollection:
        """Images whose extent touches the range."""
        return self._with_images(self.images.where(_touches(*transform_bounds((left, right, bottom, top), srs, "EPSG:4326"))))

    def find_range(self, left: float, right: float, bottom: float, top: float, start: str, end: str, srs: str = "EPSG:4326", bands: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
        """References of images within a range, with image and band."""
        box = transform_bounds((left, right, bottom, top), srs, "EPSG:4326")
        low, high = parse_time(start).value, parse_time(end).value
        images = self.images.where(_touches(*box) & F.col("datetime").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))).alias("images")
        some = F.broadcast(self.bands.where(F.col("name").isin(*bands)) if bands else self.bands).alias("bands")
        refs = self.refs.alias("refs")
        joined = refs.join(images, F.col("refs.image_id") == F.col("images.id")).join(some, F.col("refs.band_id") == F.col("bands.id"))
        if order_by:
            if bad := set(order_by) - set(ORDERS):
                raise ValueError(f"cannot order by {', '.join(sorted(bad))}")
            joined = joined.orderBy(*order_by)
        return joined.select(F.col("images.id").alias("image_id"), F.col("images.name").alias("image_name"), "refs.descriptor", F.col("images.datetime").alias("datetime"), F.col("bands.name").alias("band_name"), "refs.band_num", "images.proj")

    # -- asking ----------------------------------------------------------------
    def extent(self) -> DataFrame:
        return self.images.agg(F.min("left").alias("left"), F.max("right").alias("right"), F.min("bottom").alias("bottom"), F.max("top").alias("top"), F.min("datetime").alias("t0"), F.max("datetime").alias("t1"))

    def all_bands(self) -> DataFrame:
        """Bands by name, with the number of images that have each."""
        counts = self.refs.groupBy(F.col("band_id").alias("id")).agg(F.count_distinct("image_id").alias("image_count"))
        return self.bands.join(counts, "id", "left").select("id", "name", "type", "offset", "scale", "unit", "nodata", F.coalesce("image_count", F.lit(0).cast("long")).alias("image_count")).orderBy("name")

    def available_bands(self) -> DataFrame:
        return self.all_bands().where("image_count > 0")

    def counts(self) -> dict[str, int]:
        return {"images": self.images.count(), "bands": self.bands.count(), "refs": self.refs.count()}

    def is_empty(self) -> bool:
        return self.refs.limit(1).count() == 0

    def distinct_srs(self) -> str:
        """The one reference system of all images, or an empty text."""
        found = [r[0] for r in self.images.select("proj").distinct().limit(2).collect()]
        return found[0] or "" if len(found) == 1 else ""

    def is_aligned(self) -> bool:
        """Whether all images have one extent and reference system."""
        return self.images.select("left", "right", "top", "bottom", "proj").distinct().limit(2).count() == 1

    def pixel_size_bytes(self) -> int:
        sizes = F.create_map(*[F.lit(x) for kv in BYTES.items() for x in kv])
        return int(self.bands.agg(F.coalesce(F.sum(F.coalesce(F.try_element_at(sizes, F.col("type")), F.lit(0))), F.lit(0))).first()[0])

    def default_view(self) -> CubeView:
        """The whole extent: about 512 x 512 cells, and four slices or a few more in the coarsest unit that gives over four."""
        e = self.extent().first()
        srs = self.distinct_srs() or "EPSG:3857"
        try:
            left, right, bottom, top = transform_bounds((e["left"], e["right"], e["bottom"], e["top"]), "EPSG:4326", srs)
        except NotImplementedError:
            srs = "EPSG:3857"
            left, right, bottom, top = transform_bounds((e["left"], e["right"], e["bottom"], e["top"]), "EPSG:4326", srs)
        ratio = (right - left) / (top - bottom)
        nx = max(1, round(512 * ratio**0.5))
        ny = max(1, round(512 * 512 / nx))
        t0, t1 = Time(e["t0"], Unit.SECOND), Time(e["t1"], Unit.SECOND)
        unit = next((u for u in (Unit.YEAR, Unit.MONTH, Unit.DAY, Unit.HOUR, Unit.MINUTE) if (t1.truncate(u) - t0.truncate(u)).count > 4), Unit.SECOND)
        time = RegularTime.by_count(t0.truncate(unit), t1.truncate(unit), 4)
        time = RegularTime.by_duration(t0.truncate(unit), t1.truncate(unit), time.dt)
        ref = CubeRef(left, right, bottom, top, nx, ny, srs, time)
        return CubeView(ref, "near", "first")

    # -- scanning --------------------------------------------------------------
    def read_pixels(self, bands: list[str], srs: str | None = None) -> DataFrame:
        """``image_id, x, y, dx, dy, srs`` and bands of all pixels of the referred GeoTIFF files.

        With ``srs`` each file's coordinates are transformed from its own system as it is
        read, so files may lie in several; one in an unknown system raises.

        Each file is read by one task; the driver only lists the files that are referred to.
        """
        spark = self.refs.sparkSession
        named = self.refs.join(F.broadcast(self.bands.where(F.col("name").isin(*bands)).select(F.col("id").alias("band_id"), "name", "nodata")), "band_id")
        paths = [r[0] for r in named.select("descriptor").distinct().collect()]
        kind = "descriptor string, band_num int, x double, y double, dx double, dy double, srs string, own_nodata double, v double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    t = read_tiff(content.as_py())
                    count, height, width = t.values.shape
                    x = t.left + (np.arange(width) + 0.5) * t.dx
                    system = srs or t.srs
                    for b in range(count):
                        for row in range(0, height, 256):
                            block = t.values[b, row : row + 256].astype(float)
                            n = block.size
                            y = t.top - (np.arange(row, row + len(block)) + 0.5) * t.dy
                            px, py = np.tile(x, len(block)), np.repeat(y, width)
                            # a turned pixel counts as the box around it, so that no cell is left out
                            corners = [transform_arrays(px + i * t.dx / 2, py + j * t.dy / 2, t.srs, system) for i in (-1, 1) for j in (-1, 1)]
                            wide, high = (np.ptp([c[k] for c in corners], axis=0) for k in (0, 1))
                            px, py = transform_arrays(px, py, t.srs, system)
                            columns = [pa.array([path] * n), pa.array(np.full(n, b + 1, np.int32)), pa.array(px), pa.array(py), pa.array(wide), pa.array(high), pa.array([system] * n), pa.array([t.nodata] * n, pa.float64()), pa.array(block.ravel())]
                            yield pa.RecordBatch.from_arrays(columns, names=["descriptor", "band_num", "x", "y", "dx", "dy", "srs", "own_nodata", "v"])

        if not paths:
            return spark.createDataFrame([], "image_id long, x double, y double, dx double, dy double, srs string, " + ", ".join(f"`{b}` double" for b in bands))
        files = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, kind)
        plain = F.regexp_replace(F.col("descriptor"), "^file:(//)?", "")
        keyed = files.withColumn("descriptor", plain).join(named.withColumn("descriptor", F.regexp_replace("descriptor", "^file:(//)?", "")), ["descriptor", "band_num"])
        nodata = F.coalesce(F.expr("try_cast(nodata as double)"), F.col("own_nodata"))
        value = F.when(F.coalesce(F.col("v") != nodata, F.lit(True)), clean(F.col("v")))
        wide = keyed.groupBy("image_id", "x", "y", "dx", "dy", "srs")
        return wide.agg(*[F.max(F.when(F.col("name") == b, value)).alias(b) for b in bands])

    def cube(self, view: CubeView | None = None, bands: list[str] | None = None, pixels: DataFrame | None = None, mask: ValueMask | RangeMask | None = None, mask_band: str | None = None) -> Cube:
        """Images on a view's grid, the images of a slice aggregated by the view's rule.

        ``pixels`` has ``image_id, x, y`` and bands, in the images' reference system, and
        may have ``dx, dy``; without it the files are read. The mask hides all bands of a
        pixel; an image without a mask value stays as it is.
        """
        view = view or self.default_view()
        r = view.ref
        if view.aggregation not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation {view.aggregation!r}")
        names = bands or [b["name"] for b in self.bands.orderBy("id").collect()]
        read = [*names, *([mask_band] if mask is not None and mask_band not in names else [])]
        srs = r.srs
        if pixels is None:
            pixels = self.read_pixels(read, r.srs)
        else:
            srs = self.distinct_srs() or r.srs
        for c in ("dx", "dy"):
            if c not in pixels.columns:
                pixels = pixels.withColumn(c, F.lit(None).cast("double"))
        return scan(pixels, self.images.select(F.col("id").alias("image_id"), "datetime"), view, names, srs, mask, mask_band)

    def overviews(self, view: CubeView, path: str, factors: list[int] = (2, 4, 8, 16, 32), **options: Any) -> dict[int, str]:
        """Means on coarser grids, written as tables by factor."""
        base = self.cube(view, **options)
        out = {}
        for f in factors:
            cube = base.aggregate_space(fact=f, func="mean")
            out[f] = f"{path}/{f}"
            cube.df.write.parquet(out[f])
        return out


def _touches(left: float, right: float, bottom: float, top: float) -> Column:
    return ~((F.col("right") < left) | (F.col("left") > right) | (F.col("bottom") > top) | (F.col("top") < bottom))


def scan(pixels: DataFrame, images: DataFrame, view: CubeView, bands: list[str], srs: str | None = None, mask: ValueMask | RangeMask | None = None, mask_band: str | None = None) -> Cube:
    """Pixels of images on the view's grid. The order of image ids settles first, last and none."""
    r = view.ref
    read = [*bands, *([mask_band] if mask is not None and mask_band not in bands else [])]
    it = r.time.index_column(F.col("datetime"))
    timed = pixels.join(images.where(time_bounds(F.col("datetime"), r)).select("image_id", it.alias("it")).where(F.col("it").between(0, r.nt - 1)), "image_id")
    timed = timed.select("image_id", "it", "x", "y", "dx", "dy", *[clean(F.col(f"`{b}`")).alias(b) for b in read])
    if mask is not None:
        masked = mask_condition(F.col(f"`{mask_band}`"), mask)
        timed = timed.select("image_id", "it", "x", "y", "dx", "dy", *[F.when(~masked, F.col(f"`{b}`")).alias(b) for b in bands])
    placed = resample(timed, ["image_id", "it"], bands, r, view.resampling, srs)
    return Cube(slice_aggregate(placed, bands, view.aggregation, r), r, bands)


def slice_aggregate(placed: DataFrame, bands: list[str], how: str, r: CubeRef) -> DataFrame:
    """One row a cell from ``image_id, it, iy, ix`` rows."""
    if how == "count_images":
        per_slice = placed.groupBy("it").agg(F.count_distinct("image_id").cast("double").alias("_n"))
        seen = placed.select(*KEYS).distinct()
        return seen.join(per_slice, "it").select(*KEYS, *[F.col("_n").alias(b) for b in bands])
    grouped = placed.groupBy(*KEYS)
    values = {b: F.col(f"`{b}`") for b in bands}
    if how == "none":  # the last image counts, missing values and all
        last = grouped.agg(F.max_by(F.struct(*values.values()), F.col("image_id")).alias("_last"))
        return last.select(*KEYS, *[F.col(f"_last.`{b}`").alias(b) for b in bands])
    if how in ("first", "last"):
        pick = F.min_by if how == "first" else F.max_by
        return grouped.agg(*[pick(v, F.when(v.isNotNull(), F.col("image_id"))).alias(b) for b, v in values.items()])
    func = "count" if how == "count_values" else how
    return grouped.agg(*[aggregate_column(func, v).alias(b) for b, v in values.items()])


