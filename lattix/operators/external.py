"""User functions as programs that read a block from a file and write one.

A block is four 32-bit sizes (bands, t, y, x), then for every band the length of its
name and the name, the t, y and x labels as doubles, the length of the reference
system's text and the text, and the values as doubles. The answer is four sizes and
doubles. The program finds the files by environment variables and has to end with 0.
"""

from __future__ import annotations

import os
import shlex
import subprocess
import tempfile

import numpy as np

from ..cube import Cube
from .udf import map_chunks, udf_pixel, udf_reduce_space, udf_reduce_time, udf_time

INT = np.dtype("<i4")
FILE_IN, FILE_OUT, ACTIVE = "LATTIX_STREAM_FILE_IN", "LATTIX_STREAM_FILE_OUT", "LATTIX_STREAM"


def write_block(values: np.ndarray, bands: list[str], labels: tuple[np.ndarray, np.ndarray, np.ndarray], srs: str) -> bytes:
    parts = [np.array(values.shape, INT).tobytes()]
    for name in bands:
        parts += [np.array([len(name.encode())], INT).tobytes(), name.encode()]
    parts += [np.asarray(x, "<f8").tobytes() for x in labels]
    parts += [np.array([len(srs.encode())], INT).tobytes(), srs.encode(), np.ascontiguousarray(values, "<f8").tobytes()]
    return b"".join(parts)


def read_block(data: bytes) -> np.ndarray:
    size = np.frombuffer(data, INT, 4)
    return np.frombuffer(data, "<f8", int(np.prod(size)), 16).reshape(size)


def run_program(command: str, block: bytes) -> np.ndarray:
    with tempfile.TemporaryDirectory() as folder:  # a hand-over between two processes of one machine
        to, back = os.path.join(folder, "in"), os.path.join(folder, "out")
        with open(to, "wb") as file:
            file.write(block)
        done = subprocess.run(shlex.split(command), env={**os.environ, ACTIVE: "1", FILE_IN: to, FILE_OUT: back}, capture_output=True)
        if done.returncode:
            raise RuntimeError(f"{command!r} ended with {done.returncode}: {done.stderr[-500:].decode(errors='replace')}")
        with open(back, "rb") as file:
            return read_block(file.read())


def _caller(cube: Cube, command: str):
    bands, srs, r = list(cube.bands), cube.ref.srs, cube.ref

    def call(values: np.ndarray) -> np.ndarray:
        labels = (np.arange(values.shape[1], dtype=float), r.top - (np.arange(values.shape[2]) + 0.5) * r.dy, r.left + (np.arange(values.shape[3]) + 0.5) * r.dx)
        return run_program(command, write_block(values, bands, labels, srs))

    return call


def stream(cube: Cube, command: str, chunk_size: tuple[int, int, int]) -> Cube:
    """Chunks through a program; a block of zeros asks it for its number of bands first."""
    call = _caller(cube, command)
    probe = call(np.zeros((len(cube.bands), 1, 1, 1)))
    return map_chunks(cube, call, [f"band{k + 1}" for k in range(probe.shape[0])], chunk_size).derive_plan(cube, {"cube_type": "stream", "command": command})


def _names(nbands: int, names: list[str] | None) -> list[str]:
    return list(names) if names else [f"band{k + 1}" for k in range(nbands)]


def stream_apply_pixel(cube: Cube, command: str, nbands: int, names: list[str] | None = None, keep_bands: bool = False) -> Cube:
    call = _caller(cube, command)
    out = udf_pixel(cube, lambda v: call(v[:, None, None, :])[:, 0, 0, :], _names(nbands, names), keep_bands)
    return out.derive_plan(cube, {"cube_type": "stream_apply_pixel", "cmd": command, "nbands": nbands, "names": _names(nbands, names), "keep_bands": keep_bands})


def stream_apply_time(cube: Cube, command: str, nbands: int, names: list[str] | None = None, keep_bands: bool = False) -> Cube:
    call = _caller(cube, command)
    out = udf_time(cube, lambda v: call(v[:, :, None, None])[:, :, 0, 0], _names(nbands, names), keep_bands)
    return out.derive_plan(cube, {"cube_type": "stream_apply_time", "cmd": command, "nbands": nbands, "names": _names(nbands, names), "keep_bands": keep_bands})


def stream_reduce_time(cube: Cube, command: str, nbands: int, names: list[str] | None = None) -> Cube:
    call = _caller(cube, command)
    out = udf_reduce_time(cube, lambda v: call(v[:, :, None, None])[:, 0, 0, 0], _names(nbands, names))
    return out.derive_plan(cube, {"cube_type": "stream_reduce_time", "cmd": command, "nbands": nbands, "names": _names(nbands, names)})


def stream_reduce_space(cube: Cube, command: str, nbands: int, names: list[str] | None = None) -> Cube:
    call = _caller(cube, command)
    out = udf_reduce_space(cube, lambda v: call(v[:, None, None, :])[:, 0, 0, 0], _names(nbands, names))
    return out.derive_plan(cube, {"cube_type": "stream_reduce_space", "cmd": command, "nbands": nbands, "names": _names(nbands, names)})
