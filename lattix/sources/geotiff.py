"""GeoTIFF with numpy: strips and tiles, plain, deflate and LZW, with predictors, are read; strips are written."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Field types and tags of the format.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
LETTERS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, BYTES, PLANAR, SAMPLE_FORMAT, SCALE, TIEPOINT, GEO_KEYS, NODATA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339, 33550, 33922, 34735, 42113
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325


@dataclass
class Raster:
    """Values (band, y, x) with the upper left corner, cell sizes, reference system and no-data value."""

    values: np.ndarray
    left: float
    top: float
    dx: float
    dy: float
    srs: str = "EPSG:4326"
    nodata: float | None = None


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 starts the table anew, 257 ends. Codes widen one early."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, before = list(single), [], b""
    held = have = at = 0
    width = 9
    while True:
        while have < width:
            if at == len(data):
                return b"".join(out)
            held, have, at = (held << 8 | data[at]) & 0xFFFFFF, have + 8, at + 1
        have -= width
        code = held >> have & (1 << width) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, before = list(single), 9, b""
            continue
        if code > len(table):
            raise ValueError("damaged LZW data")
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress}


def _samples(raw: bytes, dtype: np.dtype, rows: int, width: int, deep: int, predictor: int) -> np.ndarray:
    """A block's values (y, x, sample) with its predictor undone: differences of neighbours (2), or of the bytes of floats by weight (3)."""
    if predictor == 3:
        size = dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, rows * width * deep * size).reshape(rows, -1, deep)
        summed = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, width * deep)
        return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, width, deep)
    values = np.frombuffer(raw, dtype, rows * width * deep).reshape(rows, width, deep)
    if predictor == 2:
        whole = values.astype(dtype.newbyteorder("="))
        return np.cumsum(whole, axis=1, dtype=whole.dtype)
    return values


def read(data: bytes) -> Raster:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(f"{order}I", data, 4)[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack_from(f"{order}H", data, at)[0]):
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        place = at + 10 + 12 * k
        if kind not in LETTERS:
            continue
        if SIZES[kind] * n > 4:
            place = struct.unpack_from(f"{order}I", data, place)[0]
        tags[tag] = struct.unpack_from(f"{order}{n}{LETTERS[kind]}" if kind != 2 else f"{n}s", data, place)
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    bits, form = tags.get(BITS, (1,))[0], tags.get(SAMPLE_FORMAT, (1,))[0]
    if bits % 8:
        raise NotImplementedError(f"samples of {bits} bits are not supported")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
    packed = tags.get(COMPRESSION, (1,))[0]
    if packed not in UNPACK:
        raise NotImplementedError(f"compression {packed} is not supported")
    apart = tags.get(PLANAR, (1,))[0] == 2
    tiled = TILE_WIDTH in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(ROWS, (height,))[0]))
    across, down, layers, deep = -(-width // bw), -(-height // bh), samples if apart else 1, 1 if apart else samples
    values = np.empty((samples, height, width), dtype.newbyteorder("="))
    blocks = zip(tags[TILE_OFFSETS if tiled else STRIPS], tags[TILE_BYTES if tiled else BYTES], strict=True)
    for k, (offset, size) in enumerate(blocks):
        layer, place = divmod(k, across * down)
        if layer >= layers:
            break
        y, x = place // across * bh, place % across * bw
        rows = bh if tiled else min(bh, height - y)
        block = _samples(UNPACK[packed](data[offset : offset + size]), dtype, rows, bw, deep, tags.get(PREDICTOR, (1,))[0])
        shown = block[: height - y, : width - x].transpose(2, 0, 1)
        values[layer : layer + 1 if apart else samples, y : y + shown.shape[1], x : x + shown.shape[2]] = shown
    dx, dy = tags.get(SCALE, (1.0, 1.0))[:2]
    tie = tags.get(TIEPOINT, (0, 0, 0, 0.0, 0.0, 0))
    keys = tags.get(GEO_KEYS, ())
    found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = found.get(3072) or found.get(2048) or 4326
    nodata = tags[NODATA][0].rstrip(b"\0").decode().strip() if NODATA in tags else None
    return Raster(values, tie[3] - tie[0] * dx, tie[4] + tie[1] * dy, dx, dy, f"EPSG:{code}", float(nodata) if nodata else None)


def write(r: Raster, compress: bool = False) -> bytes:
    """A little-endian file with one strip a band."""
    values = np.ascontiguousarray(r.values)
    bands, height, width = values.shape
    form = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    strips = [v.astype(values.dtype.newbyteorder("<")).tobytes() for v in values]
    if compress:
        strips = [zlib.compress(s) for s in strips]
    code = int(r.srs.upper().removeprefix("EPSG:"))
    geographic = code == 4326
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code)
    fields: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (width,)),
        (HEIGHT, 4, (height,)),
        (BITS, 3, (values.dtype.itemsize * 8,) * bands),
        (COMPRESSION, 3, (8 if compress else 1,)),
        (PHOTOMETRIC, 3, (1,)),
        (STRIPS, 4, (0,) * bands),
        (SAMPLES, 3, (bands,)),
        (ROWS, 4, (height,)),
        (BYTES, 4, tuple(map(len, strips))),
        (PLANAR, 3, (2,)),
        (SAMPLE_FORMAT, 3, (form,) * bands),
        (SCALE, 12, (r.dx, r.dy, 0.0)),
        (TIEPOINT, 12, (0.0, 0.0, 0.0, r.left, r.top, 0.0)),
        (GEO_KEYS, 3, keys),
    ]
    if r.nodata is not None:
        text = f"{r.nodata:.17g}".encode() + b"\0"
        fields.append((NODATA, 2, (text,)))

    def size(kind: int, v: tuple) -> int:
        return len(v[0]) if kind == 2 else SIZES[kind] * len(v)

    start = 8 + 2 + 12 * len(fields) + 4
    extra_at = start
    for _, kind, v in fields:
        n = size(kind, v)
        extra_at += n + n % 2 if n > 4 else 0
    offsets, at = [], extra_at
    for s in strips:
        offsets.append(at)
        at += len(s)
    fields = [(t, k, tuple(offsets) if t == STRIPS else v) for t, k, v in fields]
    entries, extra = [], b""
    for tag, kind, v in sorted(fields):
        raw = v[0] if kind == 2 else struct.pack(f"<{len(v)}{LETTERS[kind]}", *v)
        count = len(raw) if kind == 2 else len(v)
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", tag, kind, count, start + len(extra)))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries.append(struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<IH", 8, len(fields)) + b"".join(entries) + b"\0\0\0\0" + extra + b"".join(strips)
