"""Rasters made from nothing: RT_Create as a range of tile numbers and native expressions, and the list of drivers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.cube import DTYPES, Header, RasterError, compress, convert, format_code
from tilewright.geo.crs import normal
from tilewright.sources.dataset import DRIVERS
from tilewright.sources.files import open_output
from tilewright.sources.grid import Grid, created_type
from tilewright.sources.tiff import TiffWriter


def tile_rows(spark: SparkSession, grid: Grid, partitions: int | None = None, first: int = 0, end: int | None = None) -> DataFrame:
    """The fixed columns of a grid's tiles (those with first <= id < end), as native expressions over a range."""
    from tilewright.functions import st_make_envelope, st_make_ring

    g, lit = grid.transform, F.lit
    df = spark.range(first, grid.tiles_x * grid.tiles_y if end is None else end, 1, partitions)
    df = df.withColumns({"tile_x": (F.col("id") % grid.tiles_x).cast("int"), "tile_y": F.floor(F.col("id") / grid.tiles_x).cast("int")})
    df = df.withColumns({"cols": F.least(lit(grid.block_x), lit(grid.width) - F.col("tile_x") * grid.block_x), "rows": F.least(lit(grid.block_y), lit(grid.height) - F.col("tile_y") * grid.block_y)})
    col, row = F.col("tile_x") * grid.block_x, F.col("tile_y") * grid.block_y
    world = lambda c, r: (lit(g[0]) + lit(g[1]) * c + lit(g[2]) * r, lit(g[3]) + lit(g[4]) * c + lit(g[5]) * r)
    corners = [world(col + a * F.col("cols"), row + b * F.col("rows")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    box = F.struct(F.least(*[p[0] for p in corners]).alias("xmin"), F.least(*[p[1] for p in corners]).alias("ymin"), F.greatest(*[p[0] for p in corners]).alias("xmax"), F.greatest(*[p[1] for p in corners]).alias("ymax"))
    x, y = world(col + F.col("cols") / 2, row + F.col("rows") / 2)
    shape = st_make_ring(*[c for p in corners for c in p]) if g[2] or g[4] else st_make_envelope(box["xmin"], box["ymin"], box["xmax"], box["ymax"])
    return df.select("id", x.alias("x"), y.alias("y"), box.alias("bbox"), shape.alias("geometry", metadata={"crs": grid.crs}), lit(0).alias("level"), "tile_x", "tile_y", "cols", "rows", lit(grid.metadata()).alias("metadata"))


def _checked(path, crs, xmin, ymin, xmax, ymax, width, height, num_bands, data_type, nodata, driver_name, data_format, blocksize_x, blocksize_y, datacube) -> Grid:
    """The grid of a new raster, and its file if the driver has any."""
    if not crs:
        raise RasterError("The coordinate system must not be empty")
    if num_bands <= 0 or width <= 0 or height <= 0:
        raise RasterError("The number of bands, the width and the height must be greater than 0")
    driver = {d.lower(): d for d in DRIVERS}.get(driver_name.lower())
    if driver is None or not DRIVERS[driver][3]:
        raise RasterError(f"Unknown driver: {driver_name}")
    code = created_type(data_type)
    format_code(data_format)
    for size in (blocksize_x, blocksize_y):
        if size is not None and size <= 0:
            raise RasterError("The block size must be greater than 0")
    transform = (xmin, (xmax - xmin) / width, 0.0, ymax, 0.0, (ymin - ymax) / height)
    default = (width, 1) if driver == "Memory" else (256, 256)
    grid = Grid(width, height, num_bands, code, nodata, normal(crs), transform, blocksize_x or default[0], blocksize_y or default[1], data_format.upper(), datacube)
    if driver == "GTiff":
        with open_output(path) as f:  # sparse: all blocks are nodata
            TiffWriter(f, width, height, num_bands, DTYPES[code], nodata, grid.crs, transform, "NONE", max(16, -(-max(grid.block_x, grid.block_y) // 16) * 16)).close()
    return grid


def create(spark: SparkSession, path: str, crs: str, xmin: float, ymin: float, xmax: float, ymax: float, width: int, height: int, num_bands: int, data_type: int | str, nodata: float,
           driver_name: str = "Memory", data_format: str = "RAW", blocksize_x: int | None = None, blocksize_y: int | None = None, datacube: bool = False) -> DataFrame:
    """The tiles of a new raster filled with nodata. data_type: a file type code 1 to 7, or a name. `Memory` writes no file."""
    grid = _checked(path, crs, xmin, ymin, xmax, ymax, width, height, num_bands, data_type, nodata, driver_name, data_format, blocksize_x, blocksize_y, datacube)
    code = grid.data_type
    rows = tile_rows(spark, grid)
    bands = num_bands if datacube else 1
    fill = convert(np.array([nodata], np.float64), code)
    fmt = format_code(data_format)
    # a grid has four tile sizes at most: their cubes are constants
    cube = None
    for w in {grid.block_x if grid.width >= grid.block_x else grid.width, grid.width - (grid.tiles_x - 1) * grid.block_x}:
        for h in {grid.block_y if grid.height >= grid.block_y else grid.height, grid.height - (grid.tiles_y - 1) * grid.block_y}:
            head = Header(fmt, code, bands, w, h, nodata).pack()
            if fmt:
                blob = F.lit(bytearray(head + compress(np.repeat(fill, bands * w * h).tobytes(), fmt)))
            else:  # the payload is made where the row is
                blob = F.concat(F.lit(bytearray(head)), F.unhex(F.repeat(F.lit(fill.tobytes().hex()), F.col("cols") * F.col("rows") * bands)))
            here = (F.col("cols") == w) & (F.col("rows") == h)
            cube = F.when(here, blob) if cube is None else cube.when(here, blob)
    return rows.withColumns({"datacube": cube} if datacube else {f"databand_{i + 1}": cube for i in range(num_bands)})


def created_tiles(path: str, crs: str, xmin, ymin, xmax, ymax, width, height, num_bands, data_type, nodata, driver_name="Memory", data_format="RAW", blocksize_x=None, blocksize_y=None, datacube=False):
    """The rows of create, one after another, for SQL text."""
    grid = _checked(path, crs, xmin, ymin, xmax, ymax, width, height, num_bands, data_type, nodata, driver_name, data_format, blocksize_x, blocksize_y, datacube)
    fill, fmt, bands = convert(np.array([nodata], np.float64), grid.data_type), format_code(data_format), num_bands if datacube else 1
    for i in range(grid.tiles_x * grid.tiles_y):
        t = grid.tile(i)
        n = bands * t["cols"] * t["rows"]
        cube = Header(fmt, grid.data_type, bands, t["cols"], t["rows"], nodata).pack() + compress(np.repeat(fill, n).tobytes(), fmt)
        box = t["bbox"]
        yield (t["id"], t["x"], t["y"], (box["xmin"], box["ymin"], box["xmax"], box["ymax"]), t["geometry"], 0, t["tile_x"], t["tile_y"], t["cols"], t["rows"], grid.metadata(), *[cube] * (1 if datacube else num_bands))


def drivers(spark: SparkSession) -> DataFrame:
    """The formats this library reads or writes."""
    rows = [(name, long, can_create, can_copy, opener is not None, None) for name, (_, opener, long, can_create, can_copy) in DRIVERS.items()]
    return spark.createDataFrame(rows, "short_name string, long_name string, can_create boolean, can_copy boolean, can_open boolean, help_url string")
