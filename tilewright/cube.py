"""The datacube value: a 24-byte header and band-sequential, row-major cells, as one binary.

Layout, little-endian: magic, data format, pixel type, bands, columns, rows, nodata value, then the payload,
which alone may be compressed. All operators see cells as doubles.
"""

from __future__ import annotations

import struct
import sys
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

HEADER = struct.Struct("<HBBiiid")
MAGIC = 0x5253
#: What stands for "no nodata value"; minus infinity is read as the same.
NODATA_UNDEFINED = -sys.float_info.max

# Pixel types by code, as name, numpy type, code in raster files, Spark type of an element.
TYPES = (
    ("UINT8", "u1", 1, "short"),
    ("INT8", "i1", 14, "byte"),
    ("UINT16", "u2", 2, "int"),
    ("INT16", "i2", 3, "short"),
    ("UINT32", "u4", 4, "long"),
    ("INT32", "i4", 5, "int"),
    ("UINT64", "u8", 12, "decimal(20,0)"),
    ("INT64", "i8", 13, "long"),
    ("FLOAT", "f4", 6, "float"),
    ("DOUBLE", "f8", 7, "double"),
)
TYPE_CODES = {name: code for code, (name, *_) in enumerate(TYPES)}
DTYPES = tuple(np.dtype("<" + t[1]) for t in TYPES)
DOUBLE = TYPE_CODES["DOUBLE"]
# File type names by the code in raster files.
FILE_TYPES = {1: "Byte", 2: "UInt16", 3: "Int16", 4: "UInt32", 5: "Int32", 6: "Float32", 7: "Float64", 12: "UInt64", 13: "Int64", 14: "Int8"}
CODE_OF_FILE_TYPE = {t[2]: code for code, t in enumerate(TYPES)}
# Payload formats by code.
FORMATS = {"RAW": 0, "SNAPPY": 1, "GZIP": 2, "ZSTD": 3, "LZ4_RAW": 4}
_CODECS = {1: "snappy", 2: "gzip", 3: "zstd", 4: "lz4_raw"}


class RasterError(ValueError):
    """A raster, cube or argument that breaks its rules."""


def format_code(name: str) -> int:
    key = name.upper()
    key = "LZ4_RAW" if key == "LZ4" else key
    if key not in FORMATS:
        raise RasterError(f"Unknown data format: {name}")
    return FORMATS[key]


def type_code(kind: str | int) -> int:
    """A pixel type's code, from its name here or in raster files ('int16', 'Float32', 'Byte')."""
    if isinstance(kind, int):
        if not 0 <= kind < len(TYPES):
            raise RasterError(f"Unknown data type: {kind}")
        return kind
    key = {"BYTE": "UINT8", "FLOAT32": "FLOAT", "FLOAT64": "DOUBLE"}.get(kind.upper(), kind.upper())
    if key not in TYPE_CODES:
        raise RasterError(f"Unknown data type: {kind}")
    return TYPE_CODES[key]


def is_nodata(values: np.ndarray, nodata: float) -> np.ndarray:
    return np.isnan(values) if nodata != nodata else values == nodata


def is_valid(values: np.ndarray, nodata: float) -> np.ndarray:
    """Neither NaN nor infinite nor the nodata value; not the negation of is_nodata."""
    return np.isfinite(values) & (values != nodata)


@dataclass(frozen=True)
class Header:
    data_format: int = 0
    data_type: int = DOUBLE
    bands: int = 0
    cols: int = 0
    rows: int = 0
    no_data: float = NODATA_UNDEFINED

    @property
    def cells(self) -> int:
        return self.bands * self.cols * self.rows

    @property
    def dtype(self) -> np.dtype:
        return DTYPES[self.data_type]

    def pack(self) -> bytes:
        return HEADER.pack(MAGIC, self.data_format, self.data_type, self.bands, self.cols, self.rows, self.no_data)


def read_header(blob: bytes | memoryview | None) -> Header:
    if blob is None:
        raise RasterError("Cannot convert NULL blob")
    if len(blob) < HEADER.size:
        raise RasterError("Invalid datacube: shorter than its header")
    magic, *rest = HEADER.unpack_from(blob)
    if magic != MAGIC:
        raise RasterError("Invalid datacube: wrong magic code")
    head = Header(*rest)
    if head.data_type >= len(TYPES) or head.data_format >= len(FORMATS) or min(head.bands, head.cols, head.rows) < 0:
        raise RasterError("Invalid datacube: header out of range")
    return head


def compress(payload: bytes, data_format: int) -> bytes:
    if not payload or data_format == 0:
        return payload
    out = pa.Codec(_CODECS[data_format]).compress(payload, asbytes=True)
    return struct.pack("<I", len(payload)) + out if data_format == 4 else out


def decompress(payload: bytes, data_format: int, size: int) -> bytes:
    if not len(payload) or data_format == 0:
        return payload
    if data_format == 4:
        payload = payload[4:]
    return pa.Codec(_CODECS[data_format]).decompress(payload, decompressed_size=size, asbytes=True)


@dataclass(frozen=True)
class Cube:
    head: Header
    values: np.ndarray  # flat, of the head's type

    @staticmethod
    def of(values: np.ndarray, bands: int, cols: int, rows: int, no_data: float = NODATA_UNDEFINED, data_type: int | None = None) -> Cube:
        if min(bands, cols, rows) < 0:
            raise RasterError("Dimensions must not be negative")
        if values.size != bands * cols * rows:
            raise RasterError(f"Array size {values.size} does not match {bands} x {cols} x {rows}")
        code = data_type if data_type is not None else next(i for i, t in enumerate(DTYPES) if t == values.dtype.newbyteorder("<"))
        return Cube(Header(0, code, bands, cols, rows, no_data), values.astype(DTYPES[code], copy=False).ravel())

    @staticmethod
    def load(blob: bytes) -> Cube:
        head = read_header(blob)
        payload = decompress(memoryview(blob)[HEADER.size :], head.data_format, head.cells * head.dtype.itemsize)
        if len(payload) != head.cells * head.dtype.itemsize:
            raise RasterError("Invalid datacube: payload of another size than its header tells")
        values = np.frombuffer(payload, head.dtype)
        return Cube(replace(head, data_format=0), values)

    def dump(self, data_format: int = 0) -> bytes:
        return replace(self.head, data_format=data_format).pack() + compress(self.values.tobytes(), data_format)

    def doubles(self) -> np.ndarray:
        return self.values.astype(np.float64)

    def band(self, band: int) -> np.ndarray:
        """One band's cells as doubles, rows x columns."""
        if band < 0 or band >= self.head.bands:
            raise RasterError(f"Band index out of range: {band} >= {self.head.bands}")
        n = self.head.cols * self.head.rows
        return self.values[band * n : (band + 1) * n].astype(np.float64).reshape(self.head.rows, self.head.cols)


def empty_cube(data_type: int = DOUBLE) -> bytes:
    return Header(0, data_type).pack()


def convert(values: np.ndarray, code: int) -> np.ndarray:
    """Doubles to a pixel type: clamped to its range, then cut towards zero; NaN becomes 0 in whole types."""
    to = DTYPES[code]
    if to.kind == "f":
        top = np.finfo(to).max
        return np.clip(values, -float(top), float(top)).astype(to)
    info = np.iinfo(to)
    cut = np.trunc(np.nan_to_num(values, nan=0.0, posinf=np.inf, neginf=-np.inf))
    out = np.empty(cut.shape, to)
    high, low = cut >= float(info.max), cut <= float(info.min)
    mid = ~(high | low)
    out[mid] = cut[mid].astype(to)
    out[high], out[low] = info.max, info.min
    return out


def retype(cube: Cube, code: int) -> Cube:
    if cube.head.data_type == code:
        return cube
    return Cube(replace(cube.head, data_type=code), convert(cube.doubles(), code))


class Batch:
    """The cubes of an Arrow column: rows of the same header as one matrix of doubles, so numpy sees all at once."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.size = len(column)
        self.groups: list[tuple[Header, np.ndarray, np.ndarray]] = []  # header, row numbers, cells
        kinds: dict[bytes, list[int]] = {}
        blobs = column.to_pylist()
        for i, blob in enumerate(blobs):
            if blob is not None:
                kinds.setdefault(bytes(blob[: HEADER.size]), []).append(i)
        for rows in kinds.values():
            head = read_header(blobs[rows[0]])
            if head.data_format == 0 and head.cells:
                size = HEADER.size + head.cells * head.dtype.itemsize
                if any(len(blobs[i]) != size for i in rows):
                    raise RasterError("Invalid datacube: payload of another size than its header tells")
                flat = np.frombuffer(b"".join(blobs[i] for i in rows), np.uint8).reshape(len(rows), size)[:, HEADER.size :]
                cells = np.ascontiguousarray(flat).view(head.dtype).astype(np.float64)
            else:
                cells = np.stack([Cube.load(blobs[i]).doubles() for i in rows]) if head.cells else np.zeros((len(rows), 0))
            self.groups.append((replace(head, data_format=0), np.array(rows), cells))
