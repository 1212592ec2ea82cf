"""Coordinate reference systems in closed form: geographic degrees, web mercator and UTM (WGS 84).

Transformations go through degrees, for numbers, columns and arrays alike.
UTM uses the series of Krueger to the third order, exact to some millimetres.
"""

from __future__ import annotations

import math
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_RECTIFYING = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * 0.9996
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_Q = 2 * math.sqrt(_N) / (1 + _N)

_ARRAYS = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, sinh=np.sinh, cosh=np.cosh, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, atanh=np.arctanh, exp=np.exp, log=np.log, sqrt=np.sqrt, degrees=np.degrees, radians=np.radians)


def _code(srs: str) -> str:
    code = srs.strip().upper().removeprefix("EPSG:")
    if code in ("4326", "WGS84", "CRS84"):
        return "4326"
    if code in ("3857", "900913"):
        return "3857"
    return code


def _is_utm(code: str) -> bool:
    return len(code) == 5 and code[:3] in ("326", "327") and code.isdigit() and 1 <= int(code[3:]) <= 60


def same(a: str | None, b: str | None) -> bool:
    return a is None or b is None or _code(a) == _code(b)


def _utm_from(m: Any, x: Any, y: Any, zone: Any, south: Any) -> tuple[Any, Any]:
    """Degrees of UTM metres; ``m`` has the functions, for numbers or columns."""
    xi, eta = (y - south * 1e7) / _RECTIFYING, (x - 500_000.0) / _RECTIFYING
    for j, b in enumerate(_BETA, 1):
        k = 2 * j / _RECTIFYING
        xi = xi - b * m.sin(k * (y - south * 1e7)) * m.cosh(k * (x - 500_000.0))
        eta = eta - b * m.cos(k * (y - south * 1e7)) * m.sinh(k * (x - 500_000.0))
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * m.sin(2 * j * chi)
    return m.degrees(m.atan2(m.sinh(eta), m.cos(xi))) + zone * 6 - 183, m.degrees(lat)


def _utm_to(m: Any, lon: Any, lat: Any, zone: int, south: int) -> tuple[Any, Any]:
    sine = m.sin(m.radians(lat))
    t = m.sinh(m.atanh(sine) - _Q * m.atanh(_Q * sine))
    away = m.radians(lon - (zone * 6 - 183))
    xi, eta = m.atan2(t, m.cos(away)), m.atanh(m.sin(away) / m.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        y = y + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return 500_000.0 + _RECTIFYING * x, south * 1e7 + _RECTIFYING * y


def _mercator_from(m: Any, x: Any, y: Any) -> tuple[Any, Any]:
    return m.degrees(x / RADIUS), m.degrees(m.atan(m.exp(y / RADIUS)) * 2 - math.pi / 2)


def _mercator_to(m: Any, lon: Any, lat: Any) -> tuple[Any, Any]:
    return m.radians(lon) * RADIUS, m.log(m.tan(math.pi / 4 + m.radians(lat) / 2)) * RADIUS


def _degrees(m: Any, x: Any, y: Any, code: str) -> tuple[Any, Any]:
    if code == "4326":
        return x, y
    if code == "3857":
        return _mercator_from(m, x, y)
    if _is_utm(code):
        return _utm_from(m, x, y, int(code[3:]), int(code[2] == "7"))
    raise NotImplementedError(f"no transformation from EPSG:{code}")


def _from_degrees(m: Any, lon: Any, lat: Any, code: str) -> tuple[Any, Any]:
    if code == "4326":
        return lon, lat
    if code == "3857":
        return _mercator_to(m, lon, lat)
    if _is_utm(code):
        return _utm_to(m, lon, lat, int(code[3:]), int(code[2] == "7"))
    raise NotImplementedError(f"no transformation to EPSG:{code}")


def transform_point(x: float, y: float, source: str | None, target: str | None) -> tuple[float, float]:
    if same(source, target):
        return x, y
    return _from_degrees(math, *_degrees(math, x, y, _code(source)), _code(target))


def transform_columns(x: Column, y: Column, source: str | None, target: str | None) -> tuple[Column, Column]:
    if same(source, target):
        return x, y
    return _from_degrees(F, *_degrees(F, x, y, _code(source)), _code(target))


def transform_arrays(x: np.ndarray, y: np.ndarray, source: str | None, target: str | None) -> tuple[np.ndarray, np.ndarray]:
    if same(source, target):
        return x, y
    return _from_degrees(_ARRAYS, *_degrees(_ARRAYS, x, y, _code(source)), _code(target))


def transform_bounds(bounds: tuple[float, float, float, float], source: str | None, target: str | None) -> tuple[float, float, float, float]:
    """Left, right, bottom and top around the transformed corners and edges."""
    left, right, bottom, top = bounds
    steps = [0.0, 0.25, 0.5, 0.75, 1.0]
    edge = [(left + a * (right - left), bottom + b * (top - bottom)) for a in steps for b in steps if a in (0.0, 1.0) or b in (0.0, 1.0)]
    xs, ys = zip(*[transform_point(x, y, source, target) for x, y in edge], strict=True)
    return min(xs), max(xs), min(ys), max(ys)
