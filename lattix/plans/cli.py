"""Command line: ``python -m lattix.plans.cli {create_collection, info, exec, addo, translate_gtiff} ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from ..cube import Cube
from ..ref import CubeView
from ..sinks import Packing, write_cube, write_netcdf, write_tif_collection
from ..sources.catalog import ImageCollection
from .factory import from_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattix")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("create_collection", help="a catalog from file names by rules")
    a.add_argument("files", help="a text file with one file name a line")
    a.add_argument("out")
    a.add_argument("--format", required=True)
    a.add_argument("--lenient", action="store_true", help="leave out files that cannot be read by the rules")
    a = sub.add_parser("info", help="what a catalog holds")
    a.add_argument("catalog")
    a = sub.add_parser("exec", help="run a plan and write its result")
    a.add_argument("plan")
    a.add_argument("out", help="a folder, or a .nc file")
    a.add_argument("--packing", choices=["uint8", "uint16", "uint32", "int16", "int32", "float32"])
    a = sub.add_parser("addo", help="coarser tables of a catalog's images")
    a.add_argument("catalog")
    a.add_argument("out")
    a.add_argument("--view", required=True)
    a.add_argument("--levels", type=int, nargs="+", default=[2, 4, 8, 16, 32])
    a = sub.add_parser("translate_gtiff", help="a catalog's slices as GeoTIFF files")
    a.add_argument("catalog")
    a.add_argument("out")
    a.add_argument("--view", required=True)
    return p


def _view(text: str) -> CubeView:
    with open(text, encoding="utf-8") as file:
        return CubeView.from_json(json.load(file))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "create_collection":
        files = spark.read.text(a.files).withColumnRenamed("value", "descriptor")
        ImageCollection.create(files, a.format, strict=not a.lenient).write(a.out)
    elif a.what == "info":
        c = ImageCollection.read(spark, a.catalog)
        e = c.extent().first()
        print(json.dumps({**c.counts(), "extent": {k: str(e[k]) if k in ("t0", "t1") else e[k] for k in e.asDict()}, "srs": c.distinct_srs(), "bands": [r.asDict() for r in c.all_bands().collect()]}, indent=1))
    elif a.what == "exec":
        result = from_json(spark, a.plan)
        packing = Packing(a.packing) if a.packing else None
        if not isinstance(result, Cube):
            result.write.parquet(a.out)
        elif a.out.endswith(".nc"):
            write_netcdf(result, a.out, packing)
        else:
            write_cube(result, a.out)
    elif a.what == "addo":
        ImageCollection.read(spark, a.catalog).overviews(_view(a.view), a.out, a.levels)
    else:
        write_tif_collection(ImageCollection.read(spark, a.catalog).cube(_view(a.view)), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
