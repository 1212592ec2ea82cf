"""Cubes from unbounded rows."""

from .aggregate import aggregate_stream, stream_cells

__all__ = ["aggregate_stream", "stream_cells"]
