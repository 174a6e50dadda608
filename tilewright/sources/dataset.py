"""Rasters to read from: single files, virtual mosaics, mosaics and band stacks of several files, warped rasters.

All have width, height, bands, data_type, nodata, crs, transform, block_x, block_y, read(band, x, y, w, h) and
empty(x, y, w, h). Headers are read once, where a raster is planned; what is sent to a task holds paths and a few
numbers a file, and a task opens the files that its tiles meet.
"""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET

import numpy as np

from tilewright.cube import DTYPES, NODATA_UNDEFINED, RasterError, is_nodata, type_code
from tilewright.geo import crs as crs_module
from tilewright.sources import png, tiff
from tilewright.sources.files import glob, read_all, read_range

IDENTITY = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)


class NoteMixin:
    def _plain_notes(self) -> None:
        self.descriptions, self.scales, self.shifts, self.units = [""] * self.bands, [None] * self.bands, [None] * self.bands, [""] * self.bands


def _paste(out: np.ndarray, cells: np.ndarray, y: int, x: int, nodata: float) -> None:
    """Cells over out, nodata being transparent."""
    part = out[y : y + cells.shape[0], x : x + cells.shape[1]]
    if nodata == NODATA_UNDEFINED:
        part[:] = cells
    else:
        keep = ~is_nodata(cells.astype(np.float64), nodata)
        part[keep] = cells[keep]


class VrtRaster(NoteMixin):
    """A virtual raster of simple and complex sources."""

    driver = "VRT"

    def __init__(self, path: str):
        root = ET.fromstring(read_all(path).decode("utf-8"))
        if root.tag != "VRTDataset":
            raise RasterError(f"Could not open file: {path}")
        self.width, self.height = int(root.get("rasterXSize")), int(root.get("rasterYSize"))
        srs, gt = root.findtext("SRS"), root.findtext("GeoTransform")
        self.crs = crs_module.normal(srs)
        self.transform = tuple(map(float, gt.split(","))) if gt else None
        self.sources, kinds, nodata = [], set(), []
        for band in root.findall("VRTRasterBand"):
            kinds.add(band.get("dataType", "Byte"))
            nodata.append(float(band.findtext("NoDataValue", "nan")) if band.find("NoDataValue") is not None else NODATA_UNDEFINED)
            listed = []
            for source in band:
                if source.tag not in ("SimpleSource", "ComplexSource"):
                    continue
                name = source.find("SourceFilename")
                file = name.text if name.get("relativeToVRT") != "1" else os.path.join(os.path.dirname(path), name.text)
                rect = lambda tag: tuple(float(source.find(tag).get(k)) for k in ("xOff", "yOff", "xSize", "ySize"))  # noqa: B023, E731
                hole = source.findtext("NODATA")
                listed.append((file, int(source.findtext("SourceBand", "1")) - 1, rect("SrcRect"), rect("DstRect"), float(hole) if hole else NODATA_UNDEFINED))
            self.sources.append(listed)
        if len(kinds) != 1 or len({repr(n) for n in nodata}) > 1:
            raise RasterError("All bands must have the same data type and nodata value")
        self.bands, self.data_type, self.nodata = len(self.sources), type_code(kinds.pop()), nodata[0]
        self.block_x, self.block_y = min(128, self.width), min(128, self.height)
        self._open: dict[str, object] = {}
        self._plain_notes()

    def empty(self, x, y, w, h) -> bool:
        return not any(d[0] < x + w and d[0] + d[2] > x and d[1] < y + h and d[1] + d[3] > y for listed in self.sources for *_, d, _ in listed)

    def read(self, band: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        out = np.full((h, w), 0 if self.nodata == NODATA_UNDEFINED else self.nodata).astype(DTYPES[self.data_type])
        for file, i, (sx, sy, sw, sh), (dx, dy, dw, dh), hole in self.sources[band]:
            x0, x1, y0, y1 = max(x, round(dx)), min(x + w, round(dx + dw)), max(y, round(dy)), min(y + h, round(dy + dh))
            if x0 >= x1 or y0 >= y1:
                continue
            if file not in self._open:
                self._open[file] = open_file(file)
            cols = np.floor(sx + (np.arange(x0, x1) + 0.5 - dx) * sw / dw).astype(int)
            rows = np.floor(sy + (np.arange(y0, y1) + 0.5 - dy) * sh / dh).astype(int)
            cells = self._open[file].read(i, cols[0], rows[0], cols[-1] - cols[0] + 1, rows[-1] - rows[0] + 1)
            _paste(out, cells[np.ix_(rows - rows[0], cols - cols[0])].astype(out.dtype), y0 - y, x0 - x, hole)
        return out


class Lazy:
    """A file whose header has been read; the rest is opened where it is needed, and not sent along."""

    _FIELDS = ("driver", "width", "height", "bands", "data_type", "nodata", "crs", "transform", "block_x", "block_y", "descriptions", "scales", "shifts", "units")

    def __init__(self, path: str, allowed: list[str] | None = None, options: dict | None = None):
        self.path, self.allowed, self.options, self._raster = path, allowed, options, None
        raster = self._opened()
        for name in self._FIELDS:
            setattr(self, name, getattr(raster, name))
        #: No tile of it can be empty.
        self.whole = isinstance(raster, (Warped, png.PngRaster)) or (isinstance(raster, tiff.TiffRaster) and all(raster.sizes))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_raster": None}

    def _opened(self):
        if self._raster is None:
            found = open_file(self.path, self.allowed)
            self._raster = Warped(found, self.options) if self.options else found
        return self._raster

    def close(self) -> Lazy:
        self._raster = None
        return self

    def empty(self, x: int, y: int, w: int, h: int) -> bool:
        return not self.whole and self._opened().empty(x, y, w, h)

    def read(self, band: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        return self._opened().read(band, x, y, w, h)


class Mosaic(NoteMixin):
    """Several rasters of one system on the union of their extents, later ones over earlier ones, nearest cells."""

    driver = "VRT"

    def __init__(self, parts: list):
        first = parts[0]
        if len({crs_module.normal(p.crs) for p in parts}) > 1:
            raise RasterError("The files of a mosaic must have the same coordinate system")
        if len({p.bands for p in parts}) > 1 or len({p.data_type for p in parts}) > 1:
            raise RasterError("The files of a mosaic must have the same bands")
        self.parts, self.crs, self.bands, self.data_type, self.nodata = parts, first.crs, first.bands, first.data_type, first.nodata
        boxes = [extent(p) for p in parts]
        t = first.transform or IDENTITY
        self.sx, self.sy = t[1], -t[5]
        x0, y0, x1, y1 = min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)
        self.width, self.height = max(1, int((x1 - x0) / self.sx + 0.5)), max(1, int((y1 - y0) / self.sy + 0.5))
        self.transform = (x0, self.sx, 0.0, y1, 0.0, -self.sy)
        self.places = np.array([((b[0] - x0) / self.sx, (y1 - b[3]) / self.sy, (b[2] - b[0]) / self.sx, (b[3] - b[1]) / self.sy) for b in boxes])
        self.block_x, self.block_y = min(128, self.width), min(128, self.height)
        self._plain_notes()

    def _meets(self, x, y, w, h) -> np.ndarray:
        """Numbers of the parts that a window meets."""
        p = self.places
        return np.flatnonzero((p[:, 0] < x + w) & (p[:, 0] + p[:, 2] > x) & (p[:, 1] < y + h) & (p[:, 1] + p[:, 3] > y))

    def empty(self, x, y, w, h) -> bool:
        return not len(self._meets(x, y, w, h))

    def read(self, band: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        out = np.full((h, w), 0 if self.nodata == NODATA_UNDEFINED else self.nodata).astype(DTYPES[self.data_type])
        for i in self._meets(x - 1, y - 1, w + 2, h + 2).tolist():  # places are rounded to cells
            part, (dx, dy, dw, dh) = self.parts[i], self.places[i].tolist()
            x0, x1, y0, y1 = max(x, int(dx + 0.5)), min(x + w, int(dx + dw + 0.5)), max(y, int(dy + 0.5)), min(y + h, int(dy + dh + 0.5))
            if x0 >= x1 or y0 >= y1:
                continue
            cols = np.clip(np.floor((np.arange(x0, x1) + 0.5 - dx) * part.width / dw), 0, part.width - 1).astype(int)
            rows = np.clip(np.floor((np.arange(y0, y1) + 0.5 - dy) * part.height / dh), 0, part.height - 1).astype(int)
            cells = part.read(band, cols[0], rows[0], cols[-1] - cols[0] + 1, rows[-1] - rows[0] + 1)
            _paste(out, cells[np.ix_(rows - rows[0], cols - cols[0])], y0 - y, x0 - x, part.nodata)
        return out


class Stack(NoteMixin):
    """Several rasters, each a band: the first band of each, on the union of their extents."""

    driver = "VRT"

    def __init__(self, parts: list):
        whole = Mosaic([_FirstBand(p) for p in parts])
        if len({repr(p.nodata) for p in parts}) > 1:
            raise RasterError("All bands must have the same data type and nodata value")
        self.whole, self.bands = whole, len(parts)
        for name in ("width", "height", "crs", "transform", "data_type", "nodata", "block_x", "block_y"):
            setattr(self, name, getattr(whole, name))
        self.layers = []
        for part, place in zip(whole.parts, whole.places):
            layer = object.__new__(Mosaic)
            layer.__dict__.update(whole.__dict__, parts=[part], places=place[None])
            self.layers.append(layer)
        self._plain_notes()

    def empty(self, x, y, w, h) -> bool:
        return self.whole.empty(x, y, w, h)

    def read(self, band: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        return self.layers[band].read(0, x, y, w, h)


class _FirstBand:
    def __init__(self, part):
        self.__dict__.update({k: getattr(part, k) for k in ("width", "height", "crs", "transform", "data_type", "nodata")}, bands=1, part=part)

    def read(self, band, x, y, w, h):
        return self.part.read(0, x, y, w, h)


class Warped(NoteMixin):
    """A raster in another system or grid, by inverse mapping of cell centres; nearest or bilinear."""

    driver = "GTiff"

    def __init__(self, source, options: dict):
        self.source, self.bands, self.data_type = source, source.bands, source.data_type
        self.bilinear = options.get("r") == "bilinear"
        self.from_crs, self.crs = options.get("s_srs") or source.crs, crs_module.normal(options.get("t_srs") or source.crs)
        if options.get("t_srs") and not crs_module.epsg_of(self.from_crs):
            raise RasterError("The source has no known coordinate system to warp from")
        given = options.get("dstnodata")
        self.nodata = float(given) if given is not None else source.nodata
        self.source_nodata = float(options["srcnodata"]) if "srcnodata" in options else source.nodata
        self.same = crs_module.epsg_of(self.from_crs) == crs_module.epsg_of(self.crs)
        t = source.transform or IDENTITY
        # where the edges of the source lie in the target
        n = 21
        u = np.concatenate([np.linspace(0, source.width, n), np.linspace(0, source.width, n), np.zeros(n), np.full(n, source.width)])
        v = np.concatenate([np.zeros(n), np.full(n, source.height), np.linspace(0, source.height, n), np.linspace(0, source.height, n)])
        x, y = self._forward(t[0] + t[1] * u + t[2] * v, t[3] + t[4] * u + t[5] * v)
        box = [float(np.min(x)), float(np.min(y)), float(np.max(x)), float(np.max(y))]
        if "te" in options:
            box = [float(b) for b in options["te"]]
        if "ts" in options:
            self.width, self.height = (int(b) for b in options["ts"])
            rx, ry = (box[2] - box[0]) / self.width, (box[3] - box[1]) / self.height
        else:
            if "tr" in options:
                rx, ry = (abs(float(b)) for b in options["tr"])
            else:  # as many cells on the diagonal as the source has
                cx, cy = self._forward(*(np.array(p) for p in zip(*[(t[0] + t[1] * i * source.width + t[2] * j * source.height, t[3] + t[4] * i * source.width + t[5] * j * source.height) for i, j in ((0, 0), (1, 1))])))
                rx = ry = float(np.hypot(cx[1] - cx[0], cy[1] - cy[0]) / np.hypot(source.width, source.height))
            self.width, self.height = max(1, int((box[2] - box[0]) / rx + 0.5)), max(1, int((box[3] - box[1]) / ry + 0.5))
        self.transform = (box[0], rx, 0.0, box[3], 0.0, -ry)
        self.block_x, self.block_y = self.width, min(self.height, max(1, 8192 // (self.width * DTYPES[self.data_type].itemsize)))
        self._plain_notes()

    def _forward(self, x, y):
        return (x, y) if self.same else crs_module.transform_points(self.from_crs, self.crs, x, y)

    def empty(self, x, y, w, h) -> bool:
        return False

    def read(self, band: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        source, t, dtype = self.source, self.source.transform or IDENTITY, DTYPES[self.data_type]
        out = np.full((h, w), 0 if self.nodata == NODATA_UNDEFINED else self.nodata).astype(dtype)
        c, r = np.meshgrid(np.arange(x, x + w) + 0.5, np.arange(y, y + h) + 0.5)
        wx, wy = self.transform[0] + c * self.transform[1], self.transform[3] + r * self.transform[5]
        if not self.same:
            wx, wy = crs_module.transform_points(self.crs, self.from_crs, wx, wy)
        det = t[1] * t[5] - t[2] * t[4]
        sc, sr = (t[5] * (wx - t[0]) - t[2] * (wy - t[3])) / det, (t[1] * (wy - t[3]) - t[4] * (wx - t[0])) / det
        ok = (sc >= 0) & (sr >= 0) & (sc < source.width) & (sr < source.height)
        if not ok.any():
            return out
        x0, y0 = max(0, int(sc[ok].min()) - 1), max(0, int(sr[ok].min()) - 1)
        x1, y1 = min(source.width, int(sc[ok].max()) + 2), min(source.height, int(sr[ok].max()) + 2)
        cells = source.read(band, x0, y0, x1 - x0, y1 - y0)
        hole = lambda v: is_nodata(v.astype(np.float64), self.source_nodata) if self.source_nodata != NODATA_UNDEFINED else np.zeros(v.shape, bool)
        if not self.bilinear:
            found = cells[sr[ok].astype(int) - y0, sc[ok].astype(int) - x0]
            keep = ~hole(found)
            where = np.flatnonzero(ok)[keep]
            out.ravel()[where] = found[keep]
            return out
        fc, fr = sc[ok] - 0.5 - x0, sr[ok] - 0.5 - y0
        c0, r0 = np.floor(fc).astype(int), np.floor(fr).astype(int)
        total, weight = np.zeros(fc.shape), np.zeros(fc.shape)
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            cc, rr = c0 + i, r0 + j
            inner = (cc >= 0) & (rr >= 0) & (cc < cells.shape[1]) & (rr < cells.shape[0])
            v = cells[np.clip(rr, 0, cells.shape[0] - 1), np.clip(cc, 0, cells.shape[1] - 1)]
            share = np.where(inner & ~hole(v), (1 - np.abs(fc - cc)) * (1 - np.abs(fr - rr)), 0.0)
            total += share * v
            weight += share
        keep = weight > 0
        value = total[keep] / weight[keep]
        out.ravel()[np.flatnonzero(ok)[keep]] = value if dtype.kind == "f" else np.rint(value)
        return out


_FLAGS = {"t_srs": 1, "s_srs": 1, "r": 1, "tr": 2, "te": 4, "ts": 2, "dstnodata": 1, "srcnodata": 1, "of": 1, "co": 1, "overwrite": 0, "multi": 0, "q": 0}


def warp_options(tokens: list[str]) -> dict:
    """Command-line tokens as a dictionary; flags beyond the supported ones are an error."""
    out, at = {}, 0
    while at < len(tokens):
        name = tokens[at].lstrip("-")
        if not tokens[at].startswith("-") or name not in _FLAGS:
            raise RasterError(f"Unsupported warp option: {tokens[at]}")
        n = _FLAGS[name]
        values = tokens[at + 1 : at + 1 + n]
        if len(values) < n:
            raise RasterError(f"Warp option {tokens[at]} needs {n} values")
        out[name] = values[0] if n == 1 else values
        at += 1 + n
    if out.get("r", "nearest") not in ("near", "nearest", "bilinear"):
        raise RasterError(f"Unsupported resampling: {out['r']}")
    return out


def extent(raster) -> tuple[float, float, float, float]:
    t = raster.transform or IDENTITY
    xs = [t[0] + t[1] * i + t[2] * j for i in (0, raster.width) for j in (0, raster.height)]
    ys = [t[3] + t[4] * i + t[5] * j for i in (0, raster.width) for j in (0, raster.height)]
    return min(xs), min(ys), max(xs), max(ys)


#: Formats by short name: test, opener, long name, can create, can copy.
DRIVERS = {
    "GTiff": (tiff.is_tiff, tiff.TiffRaster, "GeoTIFF", True, True),
    "COG": (None, None, "Cloud optimized GeoTIFF generator", False, True),
    "PNG": (png.is_png, png.PngRaster, "Portable Network Graphics", False, True),
    "VRT": (lambda path: b"<VRTDataset" in read_range(path, 0, 512), VrtRaster, "Virtual Raster", False, False),
    "Memory": (None, None, "In Memory Raster", True, False),
}


def open_file(path: str, allowed: list[str] | None = None):
    for name, (test, opener, *_) in DRIVERS.items():
        if opener and (not allowed or name in allowed) and test(path):
            return opener(path)
    raise RasterError(f"Could not open file: {path}")


def open_raster(paths: str | list[str], separate: bool = False, warp: list[str] | None = None, allowed: list[str] | None = None):
    """A single file, a pattern (mosaic), or a list (mosaic or band stack), warped file by file if asked for."""
    if isinstance(paths, str):
        listed = glob(paths) if "*" in paths else [paths]
        single = "*" not in paths
    else:
        listed, single = list(paths), False
        if not listed:
            raise RasterError("The list of files is empty")
        if any("*" in p for p in listed):
            raise RasterError("A pattern can't be in a list of files")
    options = warp_options(warp) if warp else None
    opened = [Lazy(p, allowed if single else None, options).close() for p in listed]
    if single or (len(opened) == 1 and not separate):
        return opened[0]
    return Stack(opened) if separate else Mosaic(opened)
