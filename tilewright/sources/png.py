"""PNG reading and writing, 8 and 16 bits, with world files."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np

from tilewright.cube import NODATA_UNDEFINED, TYPE_CODES, RasterError
from tilewright.sources.files import exists, read_all, read_range

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def is_png(path: str) -> bool:
    return read_range(path, 0, 8) == SIGNATURE


def world_file(path: str) -> str:
    stem, _ = os.path.splitext(path)
    return stem + ".wld"


class PngRaster:
    driver = "PNG"

    def __init__(self, path: str):
        self.path = path
        data = read_all(path)
        at, body, palette, self.nodata = 8, b"", None, NODATA_UNDEFINED
        while at < len(data):
            n, kind = struct.unpack_from(">I4s", data, at)
            chunk = data[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                self.width, self.height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            elif kind == b"PLTE":
                palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body += chunk
            at += 12 + n
        if depth not in (8, 16) or interlaced:
            raise RasterError(f"Unsupported PNG: {depth} bits, interlaced {interlaced}")
        del palette
        self.bands = _CHANNELS[color]
        self.data_type = TYPE_CODES["UINT8" if depth == 8 else "UINT16"]
        self.dtype = np.dtype("u1" if depth == 8 else ">u2")
        self.cells = self._unfiltered(zlib.decompress(body))
        self.block_x, self.block_y = self.width, self.height
        self.crs, self.transform = "", None
        if exists(world_file(path)):
            a, d, b, e, x, y = map(float, read_all(world_file(path)).split()[:6])
            self.transform = (x - (a + b) / 2, a, b, y - (d + e) / 2, d, e)
        self.descriptions, self.scales, self.shifts, self.units = [""] * self.bands, [None] * self.bands, [None] * self.bands, [""] * self.bands

    def _unfiltered(self, data: bytes) -> np.ndarray:
        step = self.bands * self.dtype.itemsize
        rows = np.frombuffer(data, np.uint8).reshape(self.height, 1 + self.width * step)
        out = np.zeros((self.height, self.width * step), np.uint8)
        before = np.zeros(self.width * step, np.uint8)
        for y in range(self.height):
            kind, line = rows[y, 0], rows[y, 1:]
            if kind == 0:
                now = line
            elif kind == 1:
                now = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
            elif kind == 2:
                now = line + before
            else:
                now, up = np.zeros(len(line), np.uint8), before
                values, above = line.tolist(), up.tolist()
                held = [0] * len(values)
                for i, v in enumerate(values):
                    left = held[i - step] if i >= step else 0
                    if kind == 3:
                        held[i] = (v + (left + above[i]) // 2) & 255
                    else:
                        corner = above[i - step] if i >= step else 0
                        p = left + above[i] - corner
                        pa, pb, pc = abs(p - left), abs(p - above[i]), abs(p - corner)
                        held[i] = (v + (left if pa <= pb and pa <= pc else above[i] if pb <= pc else corner)) & 255
                now = np.array(held, np.uint8)
            out[y] = before = now
        return out.view(self.dtype).reshape(self.height, self.width, self.bands).astype(self.dtype.newbyteorder("="))

    def empty(self, x, y, w, h) -> bool:
        return False

    def read(self, band: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        return self.cells[y : y + h, x : x + w, band]


def write_png(stream, cells: np.ndarray) -> None:
    """cells: height x width x bands of 8 or 16 bits."""
    height, width, bands = cells.shape
    color = {1: 0, 2: 4, 3: 2, 4: 6}.get(bands)
    if color is None or cells.dtype.kind != "u" or cells.dtype.itemsize > 2:
        raise RasterError(f"PNG holds 1 to 4 bands of 8 or 16 bits, not {bands} of {cells.dtype}")
    wide = cells.astype(">u2" if cells.dtype.itemsize == 2 else "u1")

    def chunk(kind: bytes, body: bytes) -> None:
        stream.write(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))

    stream.write(SIGNATURE)
    chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8 * cells.dtype.itemsize, color, 0, 0, 0))
    lines = np.frombuffer(wide.tobytes(), np.uint8).reshape(height, -1)
    chunk(b"IDAT", zlib.compress(np.concatenate([np.zeros((height, 1), np.uint8), lines], axis=1).tobytes(), 6))
    chunk(b"IEND", b"")
