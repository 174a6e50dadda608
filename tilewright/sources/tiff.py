"""GeoTIFF reading and writing: classic and big files, strips and tiles, both byte orders.

Reads no compression, LZW, Deflate, PackBits and Zstandard, predictors 1 to 3, both planar layouts, sparse
tiles, reference systems from geo keys, nodata and band names from the usual private tags.
"""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
import zlib
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa

from tilewright.cube import NODATA_UNDEFINED, TYPES, RasterError
from tilewright.geo.crs import epsg_of
from tilewright.sources.files import read_range

# Field types as struct codes.
_FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
# Compression schemes.
SCHEMES = {"NONE": 1, "LZW": 5, "DEFLATE": 8, "PACKBITS": 32773, "ZSTD": 50000}


def lzw_decode(data: bytes) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, held, n, width, last = [], 0, 0, 9, None
    for byte in data:
        held = held << 8 | byte
        n += 8
        while n >= width:
            code = held >> (n - width) & ((1 << width) - 1)
            n -= width
            held &= (1 << n) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                del table[258:]
                width, last = 9, None
                continue
            if last is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
            size = len(table) + 1
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, n, width = bytearray(), 0, 0, 9
    table = {bytes([i]): i for i in range(256)}
    size = 258

    def put(code: int) -> None:
        nonlocal held, n
        held = held << width | code
        n += width
        while n >= 8:
            out.append(held >> (n - 8) & 0xFF)
            n -= 8
        held &= (1 << n) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size == 4094:
            put(256)
            table = {bytes([j]): j for j in range(256)}
            size, width = 258, 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = data[i : i + 1]
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if n:
        out.append(held << (8 - n) & 0xFF)
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def unpack(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == 1:
        return data
    if scheme == 5:
        return lzw_decode(data)
    if scheme in (8, 32946):
        return zlib.decompress(data)
    if scheme == 32773:
        return packbits_decode(data)
    if scheme == 50000:
        return pa.Codec("zstd").decompress(data, decompressed_size=size, asbytes=True)
    raise RasterError(f"Unsupported TIFF compression: {scheme}")


def pack(data: bytes, scheme: int) -> bytes:
    if scheme == 1:
        return data
    if scheme == 5:
        return lzw_encode(data)
    if scheme == 8:
        return zlib.compress(data, 6)
    if scheme == 50000:
        return pa.Codec("zstd").compress(data, asbytes=True)
    raise RasterError(f"Unsupported TIFF compression: {scheme}")


class TiffRaster:
    driver = "GTiff"
    #: Decoded blocks that a task keeps of a file (the option GDAL_CACHEMAX).
    cache_bytes = 64_000_000

    def __init__(self, path: str):
        self.path = path
        head = read_range(path, 0, 16)
        if head[:2] not in (b"II", b"MM"):
            raise RasterError(f"Could not open file: {path}")
        self.order = "<" if head[:2] == b"II" else ">"
        version = struct.unpack(self.order + "H", head[2:4])[0]
        if version not in (42, 43):
            raise RasterError(f"Could not open file: {path}")
        self.big = version == 43
        at = struct.unpack_from(self.order + ("Q" if self.big else "I"), head, 8 if self.big else 4)[0]
        tags = self._directory(at)
        self.width, self.height = tags[256][0], tags[257][0]
        bits, self.samples = tags.get(258, (1,)), tags.get(277, (1,))[0]
        kinds = tags.get(339, (1,))
        if len(set(bits)) > 1 or len(set(kinds)) > 1:
            raise RasterError("All bands must have the same data type")
        name = {1: "u", 2: "i", 3: "f", 4: "u"}.get(kinds[0])
        code = f"{name}{bits[0] // 8}"
        if name is None or bits[0] % 8 or code not in [t[1] for t in TYPES]:
            raise RasterError(f"Unsupported data type: {bits[0]} bits, format {kinds[0]}")
        self.data_type = [t[1] for t in TYPES].index(code)
        self.dtype = np.dtype(self.order + code)
        self.scheme, self.predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
        self.planar = tags.get(284, (1,))[0]
        self.tiled = 322 in tags
        self.block_x = tags[322][0] if self.tiled else self.width
        self.block_y = tags[323][0] if self.tiled else min(tags.get(278, (self.height,))[0], self.height)
        self.offsets, self.sizes = (tags[324], tags[325]) if self.tiled else (tags[273], tags[279])
        self.bands = self.samples
        text = tags.get(42113)
        self.nodata = float(text.decode().strip("\0 ") or "nan") if text else NODATA_UNDEFINED
        self.transform = self._transform(tags)
        self.crs = self._crs(tags)
        self.descriptions, self.scales, self.shifts, self.units = [""] * self.bands, [None] * self.bands, [None] * self.bands, [""] * self.bands
        self._notes(tags.get(42112))
        self.photometric = tags.get(262, (1,))[0]
        self._held: dict[int, np.ndarray | None] = {}

    def _directory(self, at: int) -> dict[int, tuple | bytes]:
        o, (count, entry, slot) = self.order, (8, 20, 8) if self.big else (2, 12, 4)
        n = struct.unpack(o + ("Q" if self.big else "H"), read_range(self.path, at, count))[0]
        data = read_range(self.path, at + count, n * entry)
        tags: dict[int, tuple | bytes] = {}
        for i in range(n):
            tag, kind = struct.unpack_from(o + "HH", data, i * entry)
            many = struct.unpack_from(o + ("Q" if self.big else "I"), data, i * entry + 4)[0]
            size = _SIZE.get(kind, 1) * many
            place = i * entry + entry - slot
            if size > slot:
                body = read_range(self.path, struct.unpack_from(o + ("Q" if self.big else "I"), data, place)[0], size)
            else:
                body = data[place : place + size]
            if kind in (2, 7):
                tags[tag] = body
            elif kind in _FIELD:
                tags[tag] = struct.unpack(f"{o}{many * len(_FIELD[kind])}{_FIELD[kind][0]}", body)
        return tags

    @staticmethod
    def _transform(tags) -> tuple[float, ...] | None:
        keys = tags.get(34735, ())
        half = 0.5 if any(keys[i] == 1025 and keys[i + 3] == 2 for i in range(4, len(keys), 4)) else 0.0  # pixel is point
        if 34264 in tags:
            m = tags[34264]
            found = (m[3], m[0], m[1], m[7], m[4], m[5])
        elif 33550 in tags and 33922 in tags:
            (sx, sy, *_), (i, j, _, x, y, _) = tags[33550], tags[33922][:6]
            found = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
        else:
            return None
        return (found[0] - half * (found[1] + found[2]), found[1], found[2], found[3] - half * (found[4] + found[5]), found[4], found[5])

    @staticmethod
    def _crs(tags) -> str:
        keys, codes = tags.get(34735, ()), {}
        for i in range(4, len(keys), 4):
            if keys[i + 1] == 0:
                codes[keys[i]] = keys[i + 3]
        for key in (3072, 2048):
            if codes.get(key, 32767) not in (0, 32767):
                return f"EPSG:{codes[key]}"
        return tags[34737].decode("latin-1").strip("\0|") if 34737 in tags else ""

    def _notes(self, text: bytes | None) -> None:
        if not text:
            return
        try:
            root = ET.fromstring(text.decode("utf-8", "replace").strip("\0"))
        except ET.ParseError:
            return
        for item in root.iter("Item"):
            i, role, value = int(item.get("sample", -1)), item.get("role"), item.text or ""
            if 0 <= i < self.bands:
                if role == "description":
                    self.descriptions[i] = value
                elif role == "scale":
                    self.scales[i] = float(value)
                elif role == "offset":
                    self.shifts[i] = float(value)
                elif role == "unittype":
                    self.units[i] = value

    def _block(self, index: int, rows: int, planes: int) -> np.ndarray | None:
        """A strip or tile as rows x columns x planes; None if it is not in the file."""
        if index not in self._held:
            if sum(b.nbytes for b in self._held.values() if b is not None) > self.cache_bytes:
                self._held.clear()
            if not self.sizes[index]:
                self._held[index] = None
            else:
                size = rows * self.block_x * planes * self.dtype.itemsize
                data = unpack(read_range(self.path, self.offsets[index], self.sizes[index]), self.scheme, size)[:size]
                self._held[index] = self._unpredicted(data, rows, planes)
        return self._held[index]

    def _unpredicted(self, data: bytes, rows: int, planes: int) -> np.ndarray:
        shape = (rows, self.block_x, planes)
        if self.predictor == 3:
            flat = np.frombuffer(data, np.uint8).reshape(rows, self.dtype.itemsize * self.block_x, planes) if planes == 1 else np.frombuffer(data, np.uint8).reshape(rows, -1, planes)
            summed = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, self.dtype.itemsize, self.block_x * planes)
            return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(">" + self.dtype.str[1:]).reshape(shape)
        values = np.frombuffer(data, self.dtype).reshape(shape)
        if self.predictor == 2:
            whole = np.dtype(f"u{self.dtype.itemsize}")
            native = values.astype(self.dtype.newbyteorder("="))
            values = np.cumsum(native.view(whole), axis=1, dtype=whole).view(native.dtype)
        return values

    def empty(self, x: int, y: int, w: int, h: int) -> bool:
        """Whether no block under the window is in the file."""
        across, down = -(-self.width // self.block_x), -(-self.height // self.block_y)
        return not any(self.sizes[p * across * down + r * across + c] for p in range(self.samples if self.planar == 2 else 1) for r in range(y // self.block_y, (y + h - 1) // self.block_y + 1) for c in range(x // self.block_x, (x + w - 1) // self.block_x + 1))

    def read(self, band: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        """A window of one band (from 0), as h x w of the file's type; blocks that are not in the file are nodata, or 0."""
        fill = 0 if self.nodata == NODATA_UNDEFINED else self.nodata
        out = np.full((h, w), fill if self.dtype.kind == "f" or fill == fill else 0).astype(self.dtype.newbyteorder("="))
        across, down = -(-self.width // self.block_x), -(-self.height // self.block_y)
        planes, plane = (1, 0) if self.planar == 2 else (self.samples, band)
        for r in range(y // self.block_y, (y + h - 1) // self.block_y + 1):
            rows = self.block_y if self.tiled else min(self.block_y, self.height - r * self.block_y)
            for c in range(x // self.block_x, (x + w - 1) // self.block_x + 1):
                block = self._block((band * across * down if self.planar == 2 else 0) + r * across + c, rows, planes)
                if block is None:
                    continue
                top, left = r * self.block_y, c * self.block_x
                y0, y1, x0, x1 = max(y, top), min(y + h, top + rows), max(x, left), min(x + w, left + self.block_x)
                out[y0 - y : y1 - y, x0 - x : x1 - x] = block[y0 - top : y1 - top, x0 - left : x1 - left, plane]
        return out


def geo_keys(crs: str) -> tuple[list[int], bytes]:
    code = epsg_of(crs)
    if code is None:
        text = (crs + "|").encode("latin-1", "replace")
        return ([1, 1, 0, 3, 1024, 0, 1, 32767, 1025, 0, 1, 1, 1026, 34737, len(text), 0], text) if crs else ([], b"")
    geographic = code in (4326, 4258)
    return [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code], b""


class TiffWriter:
    """Writes a tiled file tile by tile: pixels never meet in memory. Tags stand before the data."""

    def __init__(self, stream, width, height, bands, dtype, nodata, crs, transform, scheme="DEFLATE", block=256, descriptions=()):
        if scheme.upper() not in SCHEMES or scheme.upper() == "PACKBITS":
            raise RasterError(f"Unsupported TIFF compression: {scheme}")
        self.stream, self.scheme, self.block = stream, SCHEMES[scheme.upper()], block
        self.width, self.height, self.bands, self.dtype = width, height, bands, np.dtype(dtype).newbyteorder("<")
        self.across, self.down = -(-width // block), -(-height // block)
        n = self.across * self.down * bands
        kind = {"u": 1, "i": 2, "f": 3}[self.dtype.kind]
        entries = [
            (256, 4, [width]), (257, 4, [height]), (258, 3, [8 * self.dtype.itemsize] * bands), (259, 3, [self.scheme]),
            (262, 3, [2 if bands in (3, 4) and self.dtype.itemsize == 1 else 1]), (277, 3, [bands]), (284, 3, [2]), (317, 3, [1]),
            (322, 3, [block]), (323, 3, [block]), (324, 16, [0] * n), (325, 16, [0] * n), (339, 3, [kind] * bands),
        ]
        if extra := bands - (3 if bands in (3, 4) and self.dtype.itemsize == 1 else 1):
            entries.append((338, 3, [0] * extra))
        if transform is not None:
            g = transform
            if g[2] or g[4]:
                entries.append((34264, 12, [g[1], g[2], 0, g[0], g[4], g[5], 0, g[3], 0, 0, 0, 0, 0, 0, 0, 1]))
            else:
                entries += [(33550, 12, [g[1], -g[5], 0.0]), (33922, 12, [0.0, 0.0, 0.0, g[0], g[3], 0.0])] if g[5] <= 0 else [(34264, 12, [g[1], 0, 0, g[0], 0, g[5], 0, g[3], 0, 0, 0, 0, 0, 0, 0, 1])]
        keys, text = geo_keys(crs)
        if keys:
            entries.append((34735, 3, keys))
        if text:
            entries.append((34737, 2, text + b"\0"))
        if any(descriptions):
            items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(d)}</Item>' for i, d in enumerate(descriptions) if d)
            entries.append((42112, 2, f"<Metadata>{items}</Metadata>".encode() + b"\0"))
        if nodata != NODATA_UNDEFINED:
            entries.append((42113, 2, (repr(int(nodata)) if nodata == nodata and float(nodata).is_integer() else repr(nodata)).encode() + b"\0"))
        entries.sort(key=lambda e: e[0])
        self.places: dict[int, int] = {}
        head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(entries))
        tail, at = b"", 16 + 8 + 20 * len(entries) + 8
        for tag, field, values in entries:
            body = values if field == 2 else struct.pack(f"<{len(values)}{_FIELD[field]}", *values)
            head += struct.pack("<HHQ", tag, field, len(values))
            if len(body) <= 8:
                self.places[tag] = len(head)
                head += body.ljust(8, b"\0")
            else:
                self.places[tag] = at + len(tail)
                head += struct.pack("<Q", at + len(tail))
                tail += body + b"\0" * (-len(body) % 8)
        self.stream.write(head + struct.pack("<Q", 0) + tail)
        self.offsets, self.sizes = [0] * n, [0] * n

    def write(self, band: int, tile_x: int, tile_y: int, cells: np.ndarray) -> None:
        """One block x block tile of a band (edges padded)."""
        i = band * self.across * self.down + tile_y * self.across + tile_x
        data = pack(np.ascontiguousarray(cells, self.dtype).tobytes(), self.scheme)
        self.offsets[i], self.sizes[i] = self.stream.tell(), len(data)
        self.stream.write(data)

    def close(self) -> None:
        for tag, values in ((324, self.offsets), (325, self.sizes)):
            self.stream.seek(self.places[tag])
            self.stream.write(struct.pack(f"<{len(values)}Q", *values))


def is_tiff(path: str) -> bool:
    return read_range(path, 0, 2) in (b"II", b"MM") and bool(re.match(rb"II[*+]\0|MM\0[*+]", read_range(path, 0, 4)))
