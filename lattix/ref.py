"""Space-time references: the grid a cube's cells lie on. Plain data on the driver."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column

from .timeaxis import LabeledTime, RegularTime, TimeAxis

WEB_MERCATOR = 20037508.342789244


def _axis(low: float, high: float, n: int | None = None, delta: float | None = None) -> tuple[float, float, int]:
    """Bounds and count; a delta that doesn't divide the extent enlarges it on both sides."""
    if (n is None) == (delta is None):
        raise ValueError("give either a count or a cell size")
    if high <= low:
        raise ValueError("the upper bound must be above the lower one")
    if n is not None:
        return low, high, int(n)
    cells = (high - low) / delta
    n = math.ceil(cells - 1e-9)
    extra = n * delta - (high - low)
    return low - extra / 2, high + extra / 2, n


@dataclass(frozen=True)
class CubeRef:
    left: float
    right: float
    bottom: float
    top: float
    nx: int
    ny: int
    srs: str
    time: TimeAxis

    @classmethod
    def create(cls, left: float, right: float, bottom: float, top: float, *, nx: int | None = None, ny: int | None = None, dx: float | None = None, dy: float | None = None, srs: str = "EPSG:4326", t0: str | None = None, t1: str | None = None, dt: str | None = None, nt: int | None = None, labels: list[str] | None = None) -> CubeRef:
        if nx is None and dx is None and ny is not None:  # square cells
            nx = max(1, round((right - left) / ((top - bottom) / ny)))
        if ny is None and dy is None and nx is not None:
            ny = max(1, round((top - bottom) / ((right - left) / nx)))
        left, right, nx = _axis(left, right, nx, dx)
        bottom, top, ny = _axis(bottom, top, ny, dy)
        if labels is not None:
            from .timeaxis import parse_time

            time: TimeAxis = LabeledTime(tuple(parse_time(x) for x in labels))
        elif dt is not None:
            time = RegularTime.by_duration(t0, t1, dt)
        else:
            time = RegularTime.by_count(t0, t1, nt or 1)
        return cls(float(left), float(right), float(bottom), float(top), nx, ny, srs, time)

    @property
    def dx(self) -> float:
        return (self.right - self.left) / self.nx

    @property
    def dy(self) -> float:
        return (self.top - self.bottom) / self.ny

    @property
    def nt(self) -> int:
        return self.time.nt

    def with_(self, **changes) -> CubeRef:
        return replace(self, **changes)

    def ix_at(self, x: float) -> int:
        return math.floor((x - self.left) / self.dx)

    def iy_at(self, y: float) -> int:
        return math.floor((self.top - y) / self.dy)

    def ix_column(self, x: Column) -> Column:
        from pyspark.sql import functions as F

        return F.floor((x - self.left) / self.dx).cast("int")

    def iy_column(self, y: Column) -> Column:
        from pyspark.sql import functions as F

        return F.floor((self.top - y) / self.dy).cast("int")

    def same_space(self, other: CubeRef) -> bool:
        return (self.nx, self.ny, self.srs) == (other.nx, other.ny, other.srs) and all(math.isclose(getattr(self, k), getattr(other, k), rel_tol=1e-9, abs_tol=1e-9) for k in ("left", "right", "bottom", "top"))

    def crop_space(self, ix: tuple[int, int], iy: tuple[int, int]) -> CubeRef:
        return replace(self, left=self.left + ix[0] * self.dx, right=self.left + (ix[1] + 1) * self.dx, top=self.top - iy[0] * self.dy, bottom=self.top - (iy[1] + 1) * self.dy, nx=ix[1] - ix[0] + 1, ny=iy[1] - iy[0] + 1)


@dataclass(frozen=True)
class CubeView:
    """A reference with the rules for putting images on it."""

    ref: CubeRef
    resampling: str = "near"
    aggregation: str = "first"

    @classmethod
    def from_json(cls, value: str | dict) -> CubeView:
        """From a view as JSON; without an aggregation it is ``none``."""
        d = json.loads(value) if isinstance(value, str) else value
        space, time = d["space"] if "space" in d else None, d["time"]
        if "tile" in d:  # a web map tile of 256 x 256 cells
            n = 1 << int(d["tile"]["z"])
            size = 2 * WEB_MERCATOR / n
            left, top = -WEB_MERCATOR + int(d["tile"]["x"]) * size, WEB_MERCATOR - int(d["tile"]["y"]) * size
            space = {"left": left, "right": left + size, "top": top, "bottom": top - size, "nx": 256, "ny": 256, "srs": "EPSG:3857"}
        if space is None:
            raise ValueError("a view has a space or a tile")
        keys = {k: space[k] for k in ("nx", "ny", "dx", "dy") if k in space}
        times = {k: time[k] for k in ("t0", "t1", "dt", "nt") if k in time}
        ref = CubeRef.create(space["left"], space["right"], space["bottom"], space["top"], srs=space.get("srs", space.get("proj", "EPSG:4326")), **keys, **times)
        return cls(ref, d.get("resampling", "near"), d.get("aggregation", "none"))

    def to_json(self) -> dict:
        r = self.ref
        return {
            "space": {"left": r.left, "right": r.right, "bottom": r.bottom, "top": r.top, "nx": r.nx, "ny": r.ny, "srs": r.srs},
            "time": {"t0": str(r.time.t0), "t1": str(r.time.t1), "dt": str(r.time.dt)},
            "aggregation": self.aggregation,
            "resampling": self.resampling,
        }
