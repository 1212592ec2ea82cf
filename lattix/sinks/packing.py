"""Packing doubles into smaller types: ``round((v - offset) / scale)``, missing as the no-data value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import KEYS, Cube

#: Spark type, numpy type, lowest and highest value.
PACKINGS = {
    "uint8": ("smallint", "u1", 0, 255),
    "uint16": ("int", "u2", 0, 65535),
    "uint32": ("bigint", "u4", 0, 4294967295),
    "int16": ("smallint", "i2", -32768, 32767),
    "int32": ("int", "i4", -2147483648, 2147483647),
    "float32": ("float", "f4", None, None),
}


@dataclass(frozen=True)
class Packing:
    """One type for all bands, with one or as many scales, offsets and no-data values as bands."""

    kind: str
    scale: tuple[float, ...] = (1.0,)
    offset: tuple[float, ...] = (0.0,)
    nodata: tuple[float, ...] | None = None

    def __post_init__(self):
        if self.kind not in PACKINGS:
            raise ValueError(f"unknown packing {self.kind!r}")

    def of(self, k: int, bands: int) -> tuple[float, float, float]:
        """Scale, offset and no-data value of band ``k``."""
        nodata = self.nodata
        if nodata is None:
            _, _, low, high = PACKINGS[self.kind]
            nodata = (float("nan"),) if low is None else (float(high if low == 0 else low),)
        for values in (self.scale, self.offset, nodata):
            if len(values) not in (1, bands):
                raise ValueError("give one value or one for each band")
        pick = [v[k] if len(v) > 1 else v[0] for v in (self.scale, self.offset, nodata)]
        return pick[0], pick[1], pick[2]


def packed_column(value: Column, packing: Packing, k: int, bands: int) -> Column:
    scale, offset, nodata = packing.of(k, bands)
    if packing.kind == "float32":
        return F.coalesce(value, F.lit(nodata)).cast("float")
    name, _, low, high = PACKINGS[packing.kind]
    number = F.least(F.greatest(F.round((value - offset) / scale), F.lit(float(low))), F.lit(float(high)))
    return F.when(value.isNull(), F.lit(nodata)).otherwise(number).cast(name)


def pack(cube: Cube, packing: Packing) -> DataFrame:
    n = len(cube.bands)
    return cube.df.select(*KEYS, *[packed_column(cube.band(b), packing, k, n).alias(b) for k, b in enumerate(cube.bands)])
