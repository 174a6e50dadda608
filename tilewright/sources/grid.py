"""The tile grid of a raster: its rows, their places in the world, and the metadata text."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np

from tilewright.cube import FILE_TYPES, NODATA_UNDEFINED, TYPES, RasterError, type_code
from tilewright.geo.geometry import rectangle, to_wkb

VERSION = "0.1.0"


def fixed(value: float) -> str:
    """Six decimals, or all digits where six are not the value."""
    text = f"{value:f}"
    return text if float(text) == value or value != value else repr(float(value))


@dataclass
class Grid:
    width: int
    height: int
    bands: int
    data_type: int
    nodata: float
    crs: str
    transform: tuple[float, ...]
    block_x: int
    block_y: int
    data_format: str = "RAW"
    datacube: bool = False
    descriptions: list[str] = field(default_factory=list)
    scales: list = field(default_factory=list)
    shifts: list = field(default_factory=list)
    units: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.block_x <= 0 or self.block_y <= 0:
            raise RasterError("The block size must be greater than 0")

    @property
    def tiles_x(self) -> int:
        return -(-self.width // self.block_x)

    @property
    def tiles_y(self) -> int:
        return -(-self.height // self.block_y)

    def world(self, col: float, row: float) -> tuple[float, float]:
        g = self.transform
        return g[0] + g[1] * col + g[2] * row, g[3] + g[4] * col + g[5] * row

    def window(self, tile_x: int, tile_y: int) -> tuple[int, int, int, int]:
        """x, y, columns, rows."""
        x, y = tile_x * self.block_x, tile_y * self.block_y
        return x, y, min(self.block_x, self.width - x), min(self.block_y, self.height - y)

    def tile(self, index: int) -> dict:
        """The fixed columns of one tile, without metadata."""
        tile_y, tile_x = divmod(index, self.tiles_x)
        x, y, cols, rows = self.window(tile_x, tile_y)
        corners = [self.world(c, r) for c, r in ((x, y), (x + cols, y), (x + cols, y + rows), (x, y + rows))]
        box = {"xmin": min(p[0] for p in corners), "ymin": min(p[1] for p in corners), "xmax": max(p[0] for p in corners), "ymax": max(p[1] for p in corners)}
        cx, cy = self.world(x + cols / 2, y + rows / 2)
        shape = ("Polygon", [[*corners, corners[0]]]) if self.transform[2] or self.transform[4] else rectangle(box["xmin"], box["ymin"], box["xmax"], box["ymax"])
        return {"id": index, "x": cx, "y": cy, "bbox": box, "geometry": to_wkb(shape), "level": 0, "tile_x": tile_x, "tile_y": tile_y, "cols": cols, "rows": rows}

    def metadata(self) -> str:
        corners = [self.world(c, r) for c, r in ((0, 0), (self.width, 0), (self.width, self.height), (0, self.height))]
        xs, ys = [p[0] for p in corners], [p[1] for p in corners]
        ring = ", ".join(f"{fixed(x)} {fixed(y)}" for x, y in [*corners, corners[0]])
        type_name, code = FILE_TYPES[TYPES[self.data_type][2]], TYPES[self.data_type][2]
        optional = lambda values, i: fixed(values[i]) if i < len(values) and values[i] is not None else "null"
        text = lambda values, i: json.dumps(values[i] if i < len(values) else "")
        bands = ", ".join(
            f'{{"name": "databand_{i + 1}", "description": {text(self.descriptions, i)}, "type_name": "{type_name}", "data_type": {code}, "data_size": {int(TYPES[self.data_type][1][1:])}, '
            f'"width": {self.block_x}, "height": {self.block_y}, "colorinterp": 0, "nodata": {fixed(self.nodata) if self.nodata == self.nodata and abs(self.nodata) < -NODATA_UNDEFINED else "null"}, '
            f'"scale": {optional(self.scales, i)}, "offset": {optional(self.shifts, i)}, "unit": {text(self.units, i)}}}'
            for i in range(self.bands)
        )
        return (
            f'{{"file_format": "raster", "version": "{VERSION}", "data_format": "{self.data_format}", "datacube": {str(self.datacube).lower()}, "crs": {json.dumps(self.crs)}, '
            f'"transform": [{", ".join(map(fixed, self.transform))}], "bounds": [{", ".join(map(fixed, (min(xs), min(ys), max(xs), max(ys))))}], "geometry": "POLYGON(({ring}))", '
            f'"width": {self.width}, "height": {self.height}, "blocksize_x": {self.block_x}, "blocksize_y": {self.block_y}, "band_count": {self.bands}, "bands": [{bands}]}}'
        )

    @staticmethod
    def of(raster, block_x: int | None, block_y: int | None, data_format: str, datacube: bool) -> Grid:
        return Grid(raster.width, raster.height, raster.bands, raster.data_type, raster.nodata, raster.crs, raster.transform or (0.0, 1.0, 0.0, 0.0, 0.0, -1.0),
                    raster.block_x if block_x is None else block_x, raster.block_y if block_y is None else block_y, data_format, datacube, raster.descriptions, raster.scales, raster.shifts, raster.units)


@dataclass(frozen=True)
class Georef:
    """What samplers and clippers need of the metadata text."""

    transform: tuple[float, ...]
    block_x: int
    block_y: int

    @staticmethod
    def parse(text: str) -> Georef:
        try:
            value = json.loads(text)
        except (TypeError, ValueError) as e:
            raise RasterError("Invalid metadata: not a JSON object") from e
        found = value.get("transform") if isinstance(value, dict) else None
        if not isinstance(found, list) or len(found) != 6 or not all(isinstance(x, (int, float)) for x in found):
            raise RasterError("Invalid metadata: 'transform' must be an array of 6 numbers")
        for name in ("blocksize_x", "blocksize_y"):
            if not isinstance(value.get(name), int):
                raise RasterError(f"Invalid metadata: '{name}' must be an integer")
        return Georef(tuple(map(float, found)), value["blocksize_x"], value["blocksize_y"])

    def _world_to_pixel(self, x, y):
        g = self.transform
        if not g[2] and not g[4]:
            return (x - g[0]) / g[1], (y - g[3]) / g[5]
        det = g[1] * g[5] - g[2] * g[4]
        if not det:
            raise RasterError("The transform has no inverse")
        return (g[5] * (x - g[0]) - g[2] * (y - g[3])) / det, (g[1] * (y - g[3]) - g[4] * (x - g[0])) / det

    def pixel(self, x: float, y: float) -> tuple[int, int]:
        """World to pixel."""
        c, r = self._world_to_pixel(x, y)
        return int(c // 1), int(r // 1)

    def pixels(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pixel of many places."""
        c, r = self._world_to_pixel(x, y)
        return np.floor(c).astype(np.int64), np.floor(r).astype(np.int64)


def created_type(code: int | str) -> int:
    """The pixel type of RT_Create: a file type code 1 to 7, or a name."""
    from tilewright.cube import CODE_OF_FILE_TYPE

    if isinstance(code, str):
        return type_code(code)
    if code not in CODE_OF_FILE_TYPE or not 1 <= code <= 7:
        raise RasterError(f"Invalid data type: {code}")
    return CODE_OF_FILE_TYPE[code]
