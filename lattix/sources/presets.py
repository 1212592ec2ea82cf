"""Rules for the files of common products, made from the products' naming conventions.

A convention is a template of a file's path: fields in braces between fixed text. From
it follow the patterns for the file, the image's name, its time and each band. Products
of HDF files are left out: this library doesn't read HDF.
"""

from __future__ import annotations

import re
from typing import Any

#: What a field of a template may hold.
FIELDS = {
    "date": r"\d{8}",
    "dotted_date": r"\d{4}\.\d{2}\.\d{2}",
    "dotted_month": r"\d{4}\.\d{2}",
    "stamp": r"\d{8}T\d{6}",
    "date_time": r"\d{8}-\d{6}",
    "time": r"\d{6}",
    "number": r"\d+",
    "word": r"[A-Za-z0-9]+",
    "words": r"[A-Za-z0-9_-]+",
    "path": r"(?:[^/]+/)*",
}
FORMATS = {"date": "%Y%m%d", "dotted_date": "%Y.%m.%d", "dotted_month": "%Y.%m", "stamp": "%Y%m%dT%H%M%S", "date_time": "%Y%m%d-%H%M%S"}


def _pattern(template: str, group: str = "", band: str = FIELDS["words"]) -> str:
    """A regular expression for a template; the field (or the part between ``<`` and ``>``) named by ``group`` is captured."""
    out = []
    for part in re.split(r"(\{[^}]*\}|<|>)", template):
        if part in ("<", ">"):
            out.append({"<": "(", ">": ")"}[part] if group == "image" else "")
        elif part.startswith("{"):
            name = part[1:-1]
            kind = band if name == "band" else FIELDS[name.removeprefix("when:")]
            out.append(f"({kind})" if name.startswith("when:") and group == "when" else f"(?:{kind})")
        else:
            out.append(re.escape(part))
    return "(?:.*/)?" + "".join(out) + "$"


def product(template: str, bands: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """Rules from a template: ``<...>`` is the image's name, ``{when:...}`` its time, ``{band}`` the band's file part.

    A band has that part as ``file`` (all files without one), and what else is known of it.
    """
    when = re.search(r"\{when:(\w+)\}", template)[1]
    rules = {}
    for name, about in bands.items():
        known = {k: v for k, v in about.items() if k != "file"}
        rules[name] = {"pattern": _pattern(template, band=re.escape(about["file"]) if "file" in about else FIELDS["words"]), **known}
    kind = re.escape(template[template.rindex(".") :])  # any other file of that kind is one whose name can't be read
    return {"pattern": f".*{kind}$", "images": {"pattern": _pattern(template, "image")}, "datetime": {"pattern": _pattern(template, "when"), "format": FORMATS[when]}, "bands": rules}


def _files(parts: dict[str, str], **common: Any) -> dict[str, dict[str, Any]]:
    return {name: {"file": part, **common} for name, part in parts.items()}


# Band names, resolutions, no-data values and scales of the published products.
_METRES = {"B01": 60, "B02": 10, "B03": 10, "B04": 10, "B05": 20, "B06": 20, "B07": 20, "B08": 10, "B8A": 20, "B09": 60, "B11": 20, "B12": 20}
_SAFE = "<{word}_MSI%s_{when:stamp}_{words}>.SAFE/{path}IMG_DATA/{path}{words}_{band}.jp2"
PRESETS: dict[str, dict[str, Any]] = {
    "chirps_daily": product("<chirps-v2.0.{when:dotted_date}>.tif", {"precipitation": {"nodata": -9999}}),
    "chirps_monthly": product("<chirps-v2.0.{when:dotted_month}>.tif", {"precipitation": {"nodata": -9999}}),
    "landsat8_l1tp": product("<LC08_L1TP_{number}_{when:date}_{date}_{word}_{word}>_{band}.TIF", _files({f"B{k:02}": f"B{k}" for k in range(1, 12)}, nodata=0) | _files({"BQA": "BQA"})),
    "landsat8_sr": product("<LC08_{word}_{number}_{when:date}_{date}_{word}_{word}>_{band}.tif", _files({f"B{k:02}": f"sr_band{k}" for k in range(1, 8)}, nodata=-9999, scale=0.0001) | _files({"PIXEL_QA": "pixel_qa"})),
    "planetscope_sr": product("<{when:date}_{time}_{words}>_AnalyticMS_{band}.tif", {c: {"file": "SR", "band": k, "nodata": 0} for k, c in enumerate(("blue", "green", "red", "nir"), 1)} | {"udm": {"file": "DN_udm"}}),
    "sentinel1_grd": product("<{word}_IW_GRDH_1SDV_{when:stamp}_{words}>.SAFE/measurement/{word}-iw-grd-{band}-{words}.tiff", _files({"VH": "vh", "VV": "vv"}, nodata=0)),
    "sentinel2_l1c": product(_SAFE % "L1C", _files({b: b for b in (*_METRES, "B10")}, nodata=0, scale=0.0001)),
    "sentinel2_l2a": product(_SAFE % "L2A", _files({b: f"{b}_{m}m" for b, m in _METRES.items()}, nodata=0, scale=0.0001) | _files({"SCL": "SCL_20m"})),
    "sentinel2_theia": product("<{word}_{when:date_time}-{number}_L2A_{word}_{word}_{word}-{word}>_FRE_{band}.tif", _files({b: b for b in ("B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12")}, nodata=-10000, scale=0.0001)),
}
