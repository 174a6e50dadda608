"""Raster files as tables: read_tiles, and the Spark data sources `raster` (a row a tile) and `raster_cells` (a row a cell).

    read_tiles(spark, "/data/*.tif", blocksize_x=256, blocksize_y=256).where("tile_y < 10").select("id", "databand_1")
    spark.read.format("raster").option("blocksize_x", 256).option("blocksize_y", 256).load("/data/*.tif")

read_tiles is a plan of native expressions over a range of tile numbers; each band is an Arrow function of the number
that reads the tile. So Catalyst prunes and pushes down as with any table: columns that nobody asks for are not
computed, bands among them; filters on the other columns choose tiles before any is read, LIMIT stops reading.

Options: paths (a JSON list, instead of load's path), allowed_drivers and
warp_options (JSON lists), separate_bands, data_format, blocksize_x, blocksize_y, skip_empty_tiles, datacube,
bands (a JSON list of band numbers from 1: the others are neither read nor returned), ignore_nodata (cells),
tiles_per_partition, bbox ([xmin, ymin, xmax, ymax]: only tiles that meet it), where (a JSON list of
[column, test, value] on the tiles' numeric columns, all of which must hold). open_options and sibling_files are for
drivers that need them; none here does, so other values than an empty list are an error. In the data sources bbox and
where prune tiles on the driver, before any is read. Spark's own filter pushdown for Python sources is not used there:
it keeps what one query pushed for later queries on the same DataFrame.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilewright.cube import DTYPES, TYPES, Header, RasterError, compress, empty_cube, format_code, is_nodata
from tilewright.sources.create import tile_rows
from tilewright.sources.dataset import open_raster
from tilewright.sources.grid import Grid
from tilewright.sources.tiff import TiffRaster

BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])
TILE_FIELDS = [("id", T.LongType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("bbox", BBOX), ("geometry", T.BinaryType()), ("level", T.IntegerType()), ("tile_x", T.IntegerType()), ("tile_y", T.IntegerType()), ("cols", T.IntegerType()), ("rows", T.IntegerType()), ("metadata", T.StringType())]
CELL_FIELDS = [("id", T.LongType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("geometry", T.BinaryType()), ("col", T.IntegerType()), ("row", T.IntegerType())]


def _flag(value: str | None, default: bool) -> bool:
    return default if value is None else value.lower() in ("true", "1", "yes")


class Options:
    def __init__(self, options: dict):
        get = lambda name: options.get(name)
        for name in ("open_options", "sibling_files"):
            if get(name) and json.loads(get(name)):
                raise RasterError(f"{name} has no effect on the drivers there are: {get(name)}")
        paths = json.loads(get("paths")) if get("paths") else get("path")
        if not paths:
            raise RasterError("No path was given")
        listed = lambda name: json.loads(get(name)) if get(name) else []
        self.raster = open_raster(paths, _flag(get("separate_bands"), False), listed("warp_options"), listed("allowed_drivers"))
        number = lambda name: int(get(name)) if get(name) is not None else None
        self.data_format = (get("data_format") or "RAW").upper()
        self.format_code = format_code(self.data_format)
        self.datacube = _flag(get("datacube"), False)
        self.grid = Grid.of(self.raster, number("blocksize_x"), number("blocksize_y"), self.data_format, self.datacube)
        self.skip_empty = _flag(get("skip_empty_tiles"), True)
        self.ignore_nodata = number("ignore_nodata") or 0
        if self.ignore_nodata not in (0, 1, 2):
            raise RasterError("ignore_nodata must be 0, 1 or 2")
        self.bands = [b - 1 for b in listed("bands")] or list(range(self.raster.bands))
        if any(not 0 <= b < self.raster.bands for b in self.bands):
            raise RasterError(f"Band out of range: the raster has {self.raster.bands}")
        self.per_partition = number("tiles_per_partition")
        self.bbox = listed("bbox")
        self.where = listed("where")
        self.permissive = (get("mode") or "").upper() == "PERMISSIVE"
        self.cache_bytes = int(float(get("GDAL_CACHEMAX")) * 1_000_000) if get("GDAL_CACHEMAX") else TiffRaster.cache_bytes
        self.debug = (get("CPL_DEBUG") or "").upper() in ("ON", "YES", "TRUE", "1")


class Tiles(InputPartition):
    """Runs of tiles, first and last of each."""

    def __init__(self, *runs: tuple[int, int]):
        super().__init__(runs)
        self.runs = runs

    def numbers(self) -> Iterator[int]:
        for first, last in self.runs:
            yield from range(first, last + 1)


_TESTS = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: np.isin(a, list(b))}


_ELEMENT = {"short": T.ShortType(), "byte": T.ByteType(), "int": T.IntegerType(), "long": T.LongType(), "decimal(20,0)": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType()}


class GridColumns:
    """The numeric columns of all tiles of a grid as arrays, for pruning."""

    def __init__(self, grid: Grid):
        self.grid, self.index = grid, np.arange(grid.tiles_x * grid.tiles_y)

    def get(self, name: tuple[str, ...]) -> np.ndarray | None:
        g, i = self.grid, self.index
        tile_x, tile_y = i % g.tiles_x, i // g.tiles_x
        cols, rows = np.minimum(g.block_x, g.width - tile_x * g.block_x), np.minimum(g.block_y, g.height - tile_y * g.block_y)
        if name == ("id",):
            return i
        if name in (("tile_x",), ("tile_y",), ("cols",), ("rows",)):
            return {"tile_x": tile_x, "tile_y": tile_y, "cols": cols, "rows": rows}[name[0]]
        if name == ("level",):
            return np.zeros_like(i)
        x, y = tile_x * g.block_x, tile_y * g.block_y
        if name in (("x",), ("y",)):
            return g.world(x + cols / 2, y + rows / 2)[name == ("y",)]
        if len(name) == 2 and name[0] == "bbox":
            corners = [g.world(x + a * cols, y + b * rows) for a in (0, 1) for b in (0, 1)]
            axis = name[1][0] == "y"
            return (np.minimum if name[1].endswith("min") else np.maximum).reduce([p[axis] for p in corners])
        return None


class TileReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema

    def kept(self, grid: Grid, bbox: list, where: list) -> np.ndarray:
        columns = GridColumns(grid)
        keep = np.ones(len(columns.index), bool)
        for name, test, value in where:
            found = columns.get(tuple(name.split(".")))
            if found is None or test not in _TESTS:
                raise RasterError(f"Tiles can't be chosen by {name} {test}")
            keep &= _TESTS[test](found, value)
        if bbox:
            keep &= (columns.get(("bbox", "xmin")) <= bbox[2]) & (columns.get(("bbox", "xmax")) >= bbox[0]) & (columns.get(("bbox", "ymin")) <= bbox[3]) & (columns.get(("bbox", "ymax")) >= bbox[1])
        return columns.index[keep]

    def partitions(self):
        o = Options(self.options)
        kept = self.kept(o.grid, o.bbox, o.where)
        cells = o.grid.block_x * o.grid.block_y * max(1, len(o.bands))
        most = o.per_partition or max(1, 4_000_000 // max(1, cells))
        out = []
        for i in range(0, len(kept), most):
            part = kept[i : i + most]
            heads = np.flatnonzero(np.diff(part, prepend=part[:1] - 2) != 1)
            ends = np.append(heads[1:], len(part)) - 1
            out.append(Tiles(*zip(part[heads].tolist(), part[ends].tolist())))
        return out or [Tiles()]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        o, schema = Options(self.options), to_arrow_schema(self.schema)
        grid, raster, metadata = o.grid, o.raster, o.grid.metadata()
        held, size = [], 0
        for index in partition.numbers():
            row = grid.tile(index)
            x, y, w, h = grid.window(row["tile_x"], row["tile_y"])
            if o.skip_empty and raster.empty(x, y, w, h):
                continue
            row["metadata"] = metadata
            head = lambda n: Header(o.format_code, grid.data_type, n, w, h, grid.nodata).pack()  # noqa: B023, E731
            cells = []
            for b in o.bands:
                try:
                    cells.append(np.ascontiguousarray(raster.read(b, x, y, w, h), DTYPES[grid.data_type]).tobytes())
                except RasterError:
                    if not o.permissive:
                        raise
                    cells.append(None)
            if o.datacube:
                row["datacube"] = empty_cube(grid.data_type) if None in cells else head(len(cells)) + compress(b"".join(cells), o.format_code)
            else:
                for b, data in zip(o.bands, cells):
                    row[f"databand_{b + 1}"] = empty_cube(grid.data_type) if data is None else head(1) + compress(data, o.format_code)
            held.append(row)
            size += sum(len(c or b"") for c in cells)
            if size > 16_000_000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class CellReader(TileReader):
    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        o, schema = Options(self.options), to_arrow_schema(self.schema)
        grid, raster = o.grid, o.raster
        for index in partition.numbers():
            tile_y, tile_x = divmod(index, grid.tiles_x)
            x, y, w, h = grid.window(tile_x, tile_y)
            if o.skip_empty and raster.empty(x, y, w, h):
                continue
            # ids number the cells tile by tile: whole rows of tiles before, then the tiles to the left
            first = y * grid.width + x * h
            ids = first + np.arange(w * h)
            cols, rows = np.tile(np.arange(x, x + w), h), np.repeat(np.arange(y, y + h), w)
            values = [raster.read(b, x, y, w, h).astype(DTYPES[grid.data_type]).ravel() for b in o.bands]
            if o.ignore_nodata:
                holes = np.stack([is_nodata(v.astype(np.float64), grid.nodata) for v in values])
                keep = ~(holes.any(axis=0) if o.ignore_nodata == 1 else holes.all(axis=0))
                ids, cols, rows, values = ids[keep], cols[keep], rows[keep], [v[keep] for v in values]
            px, py = grid.world(cols + 0.5, rows + 0.5)
            points = np.zeros(len(ids), np.dtype([("o", "u1"), ("k", "<u4"), ("x", "<f8"), ("y", "<f8")]))
            points["o"], points["k"], points["x"], points["y"] = 1, 1, px, py
            raw = points.tobytes()
            shapes = pa.Array.from_buffers(pa.binary(21), len(ids), [None, pa.py_buffer(raw)]).cast(pa.binary())
            arrays = [pa.array(ids, pa.int64()), pa.array(px), pa.array(py), shapes, pa.array(cols, pa.int32()), pa.array(rows, pa.int32())]
            for v, kind in zip(values, schema.types[6:]):
                arrays.append(pa.array([Decimal(int(c)) for c in v], kind) if pa.types.is_decimal(kind) else pa.array(v).cast(kind))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> T.StructType:
        o = Options(self.options)
        names = ["datacube"] if o.datacube else [f"databand_{b + 1}" for b in o.bands]
        meta = {"crs": o.grid.crs}
        fields = [T.StructField(n, t, metadata=meta if n == "geometry" else None) for n, t in TILE_FIELDS]
        return T.StructType(fields + [T.StructField(n, T.BinaryType()) for n in names])

    def reader(self, schema: T.StructType) -> TileReader:
        return TileReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool):
        from tilewright.sources.writer import RasterWriter

        return RasterWriter(dict(self.options), schema, overwrite)


class CellSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster_cells"

    def schema(self) -> T.StructType:
        o = Options(self.options)
        kind = _ELEMENT[TYPES[o.grid.data_type][3]]
        return T.StructType([T.StructField(n, t) for n, t in CELL_FIELDS] + [T.StructField(f"band_{b + 1}", kind) for b in o.bands])

    def reader(self, schema: T.StructType) -> CellReader:
        return CellReader(dict(self.options), schema)


def read_tiles(spark, path, bbox=None, where=(), cells: bool = False, **options):
    """A tile (or cell) table. path: a path, a pattern or a list; other options as above, lists as lists."""
    plain = {k: json.dumps(list(v)) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    plain |= {"path": path} if isinstance(path, str) else {"paths": json.dumps(list(path))}
    o = Options({k: v for k in ("GDAL_CACHEMAX", "CPL_DEBUG") if (v := spark.conf.get(f"spark.tilewright.{k}", None))} | plain)
    grid = o.grid
    first, end = _span(grid, bbox) if bbox else (0, grid.tiles_x * grid.tiles_y)
    most = o.per_partition or max(1, 4_000_000 // max(1, grid.block_x * grid.block_y * max(1, len(o.bands))))
    rows = tile_rows(spark, grid, max(1, -(-(end - first) // most)), first, end)
    for name, test, value in where:
        if test not in _TESTS or name.split(".")[0] not in {n for n, t in TILE_FIELDS if t not in (T.BinaryType(), T.StringType())}:
            raise RasterError(f"Tiles can't be chosen by {name} {test}")
        rows = rows.where(F.col(name).isin(list(value)) if test == "in" else _TESTS[test](F.col(name), value))
    if bbox:
        b = F.col("bbox")
        rows = rows.where((b["xmin"] <= bbox[2]) & (b["xmax"] >= bbox[0]) & (b["ymin"] <= bbox[3]) & (b["ymax"] >= bbox[1]))
    scan = Scan(o)
    if o.skip_empty and not getattr(o.raster, "whole", False):
        rows = rows.where(~scan.column("empty", T.BooleanType())("id"))
    if cells:
        return _cell_rows(rows, o, scan)
    if o.datacube:
        return rows.withColumn("datacube", scan.column("cube", T.BinaryType(), *o.bands)("id"))
    return rows.withColumns({f"databand_{i + 1}": scan.column("cube", T.BinaryType(), i)("id") for i in o.bands})


def _span(grid: Grid, bbox) -> tuple[int, int]:
    """The tile numbers, first to end, among which those that meet a box are: whole rows of tiles."""
    if grid.transform[2] or grid.transform[4]:
        return 0, grid.tiles_x * grid.tiles_y
    rows = sorted((y - grid.transform[3]) / grid.transform[5] / grid.block_y for y in (bbox[1], bbox[3]))
    low, high = max(0, int(rows[0]) - 1), min(grid.tiles_y, int(max(rows[1], -1)) + 2)
    return low * grid.tiles_x, max(low, high) * grid.tiles_x


def _cell_rows(rows, o: Options, scan: Scan):
    """The cells of tile rows. Ids number them tile by tile: whole rows of tiles before, then the tiles to the left."""
    grid = o.grid
    g, names = grid.transform, [f"band_{i + 1}" for i in o.bands]
    kind = _ELEMENT[TYPES[grid.data_type][3]]
    held = rows.select("tile_x", "tile_y", "cols", "rows", *[scan.column("cells", T.ArrayType(kind), i)("id").alias(n) for i, n in zip(o.bands, names)])
    flat = held.select("tile_x", "tile_y", "cols", "rows", F.posexplode(F.arrays_zip(*names)).alias("_i", "_v"))
    x, y = F.col("tile_x") * grid.block_x, F.col("tile_y") * grid.block_y
    flat = flat.select(
        (y.cast("long") * grid.width + x.cast("long") * F.col("rows") + F.col("_i")).alias("id"),
        (x + F.col("_i") % F.col("cols")).alias("col"), (y + F.floor(F.col("_i") / F.col("cols"))).cast("int").alias("row"), *[F.col(f"_v.{n}").alias(n) for n in names],
    )
    if o.ignore_nodata:
        hole = lambda n: F.isnan(F.col(n).cast("double")) if grid.nodata != grid.nodata else F.col(n).cast("double") == float(grid.nodata)
        holes = [hole(n) for n in names]
        flat = flat.where(~reduce((lambda a, b: a | b) if o.ignore_nodata == 1 else (lambda a, b: a & b), holes))
    c, r = F.col("col") + 0.5, F.col("row") + 0.5
    px, py = F.lit(g[0]) + F.lit(g[1]) * c + F.lit(g[2]) * r, F.lit(g[3]) + F.lit(g[4]) * c + F.lit(g[5]) * r
    from tilewright.functions import st_point

    return flat.select("id", px.alias("x"), py.alias("y"), st_point(px, py).alias("geometry", metadata={"crs": grid.crs}), "col", "row", *names)


LOG = logging.getLogger("tilewright")
#: Rasters that a worker has open, by scan.
_OPEN: dict[str, Options] = {}


class Scan:
    """Arrow functions of tile numbers. What is sent to a task are the planned raster's paths and numbers."""

    def __init__(self, o: Options):
        self.options, self.name = o, uuid.uuid4().hex

    def column(self, what: str, kind: T.DataType, *bands: int):
        def run(ids: pa.Array) -> pa.Array:
            if self.name not in _OPEN:
                if len(_OPEN) > 3:
                    _OPEN.clear()
                _OPEN[self.name] = self.options
            TiffRaster.cache_bytes = self.options.cache_bytes
            return getattr(self, what)(_OPEN[self.name], ids.to_pylist(), bands)

        return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)

    @staticmethod
    def _window(o: Options, index: int) -> tuple[int, int, int, int]:
        window = o.grid.window(index % o.grid.tiles_x, index // o.grid.tiles_x)
        if o.debug:
            if not LOG.handlers:
                LOG.addHandler(logging.StreamHandler())
                LOG.setLevel(logging.INFO)
            LOG.info("tile %d: columns %d and %d more, rows %d and %d more", index, window[0], window[2], window[1], window[3])
        return window

    def empty(self, o: Options, ids: list, bands: tuple) -> pa.Array:
        return pa.array([o.raster.empty(*self._window(o, i)) for i in ids], pa.bool_())

    def _read(self, o: Options, band: int, window: tuple) -> np.ndarray | None:
        try:
            return np.ascontiguousarray(o.raster.read(band, *window), DTYPES[o.grid.data_type])
        except RasterError:
            if o.permissive:
                return None
            raise

    def cube(self, o: Options, ids: list, bands: tuple) -> pa.Array:
        out = []
        for i in ids:
            window = self._window(o, i)
            cells = [self._read(o, b, window) for b in bands]
            if any(c is None for c in cells):
                out.append(empty_cube(o.grid.data_type))
            else:
                head = Header(o.format_code, o.grid.data_type, len(bands), window[2], window[3], o.grid.nodata)
                out.append(head.pack() + compress(b"".join(c.tobytes() for c in cells), o.format_code))
        return pa.array(out, pa.binary())

    def cells(self, o: Options, ids: list, bands: tuple) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(_ELEMENT[TYPES[o.grid.data_type][3]])
        found = [o.raster.read(bands[0], *self._window(o, i)).astype(DTYPES[o.grid.data_type]) for i in ids]
        flat = np.concatenate([c.ravel() for c in found]) if found else np.zeros(0, DTYPES[o.grid.data_type])
        values = pa.array([Decimal(c) for c in flat.tolist()], kind) if pa.types.is_decimal(kind) else pa.array(flat).cast(kind)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(c.size for c in found)]), pa.int32()), values)


def register(spark) -> None:
    """Makes the formats `raster` and `raster_cells` known to a session."""
    spark.dataSource.register(RasterSource)
    spark.dataSource.register(CellSource)
