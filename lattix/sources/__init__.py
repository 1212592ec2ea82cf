"""Ways to make cubes: from rows, rasters, files, catalogs, or out of nothing."""

from .basic import dummy, empty, from_cells, from_frames, from_points, read_cube
from .catalog import ImageCollection
from .netcdf import from_netcdf

__all__ = ["ImageCollection", "dummy", "empty", "from_cells", "from_frames", "from_netcdf", "from_points", "read_cube"]
