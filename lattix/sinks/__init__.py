"""Ways to write cubes."""

from .files import write_chunks, write_cube, write_netcdf, write_png_collection, write_tif_collection
from .packing import PACKINGS, Packing, pack

__all__ = ["PACKINGS", "Packing", "pack", "write_chunks", "write_cube", "write_netcdf", "write_png_collection", "write_tif_collection"]
