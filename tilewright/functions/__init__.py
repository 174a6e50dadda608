"""The rt_* and st_* functions on columns, and their registration under their SQL names.

Each is one Arrow function. Those on cubes handle cubes of the same shape as one matrix, and those on geometry
handle rectangles as one array; other shapes, texts and lists of coordinates go row by row. A null argument gives
null, except that rt_cube_null_or_empty of null is true. For longer algebra use tilewright.plans.expr.cube, which
runs a whole expression at one go.
"""

from __future__ import annotations

from decimal import Decimal
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.cube import DTYPES, TYPE_CODES, TYPES, Batch, Cube, Header, RasterError, convert, format_code, is_nodata, type_code
from tilewright.geo import crs as crs_module
from tilewright.geo import geometry as geo
from tilewright.operators import algebra, stats
from tilewright.plans.expr import evaluate, fill, from_spark, to_column
from tilewright.sources.grid import Georef

#: SQL name -> (function on Arrow columns, result type).
REGISTRY: dict[str, tuple] = {}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _define(sql_name: str, run, kind: T.DataType):
    """Registers run(*Arrow columns) and returns the function on Spark columns."""
    REGISTRY[sql_name] = (run, kind)

    def call(*columns) -> Column:
        return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)(*[_col(c) for c in columns])

    call.__name__ = sql_name
    return call


def _rows(run, kind: T.DataType, nulls: bool = False):
    """Arrow columns row by row: run(*values) -> value; any null gives null unless nulls."""
    arrow = from_spark(kind)

    def whole(*columns: pa.Array) -> pa.Array:
        lists = [c.to_pylist() for c in columns]
        return pa.array([run(*row) if nulls or not any(v is None for v in row) else None for row in zip(*lists)], arrow)

    return whole


@lru_cache(maxsize=512)
def georef(metadata: str) -> Georef:
    return Georef.parse(metadata)


def _cases(cubes: pa.Array, *columns: pa.Array):
    """(head, rows, cells, values): rows alike in their header and in all other columns; those with a null are left out."""
    lists = [c.to_pylist() for c in columns]
    for head, rows, cells in Batch(cubes).groups:
        kinds: dict[tuple, list[int]] = {}
        for j, r in enumerate(rows.tolist()):
            key = tuple(values[r] for values in lists)
            if not any(v is None for v in key):
                kinds.setdefault(key, []).append(j)
        for key, js in kinds.items():
            yield (head, rows, cells, key) if len(js) == len(rows) else (head, rows[js], cells[js], key)


def _band(head: Header, cells: np.ndarray, band: int) -> np.ndarray:
    """One band of many cubes, tiles x cells."""
    if band < 0 or band >= head.bands:
        raise RasterError(f"Band index out of range: {band} >= {head.bands}")
    n = head.cols * head.rows
    return cells[:, band * n : (band + 1) * n]


def _numbers(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """A column of numbers; null is 0."""
    return column.cast(pa.float64() if kind is np.float64 else pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _null(*columns: pa.Array) -> np.ndarray:
    """Rows with a null in any column."""
    return np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])


def _leaf(column: pa.Array):
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return Batch(column), "leaf"
    return (column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)), "scalar"


# ---- arrays and types ----

_ELEMENTS = {"int8": "INT8", "int16": "INT16", "int32": "INT32", "int64": "INT64", "float": "FLOAT", "double": "DOUBLE", "uint8": "UINT8", "uint16": "UINT16", "uint32": "UINT32", "uint64": "UINT64"}
_SPARK = {"short": T.ShortType(), "byte": T.ByteType(), "int": T.IntegerType(), "long": T.LongType(), "decimal(20,0)": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType()}
_TITLES = {"UINT8": "UInt8", "INT8": "Int8", "UINT16": "UInt16", "INT16": "Int16", "UINT32": "UInt32", "INT32": "Int32", "UINT64": "UInt64", "INT64": "Int64", "FLOAT": "Float", "DOUBLE": "Double"}


def _array2cube(values: pa.Array, data_format: pa.Array, bands: pa.Array, cols: pa.Array, rows: pa.Array, no_data: pa.Array, *data_type: pa.Array) -> pa.Array:
    element = values.type.value_type
    name = "UINT64" if pa.types.is_decimal(element) and element.scale == 0 and element.precision >= 19 else "DOUBLE" if pa.types.is_decimal(element) else _ELEMENTS.get(str(element))
    if name is None:
        raise RasterError(f"Unsupported element type: {element}")
    size = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(values)
    starts = np.cumsum(size) - size
    if flat.null_count:
        raise RasterError("An array with NULL can't become a datacube")
    if pa.types.is_decimal(element):
        cells = np.array([int(x) for x in flat.to_pylist()], np.uint64) if name == "UINT64" else flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    else:
        cells = flat.to_numpy(zero_copy_only=False)
    kinds: dict[tuple, list[int]] = {}
    lists = [c.to_pylist() for c in (data_format, bands, cols, rows, no_data)]
    types = data_type[0].to_pylist() if data_type else [None] * len(values)
    for i, (missing, kind, *here) in enumerate(zip(_null(values).tolist(), types, *lists)):
        if not missing and not any(v is None for v in here):
            kinds.setdefault((*here, kind), []).append(i)
    out: list = [None] * len(values)
    for (fmt, b, c, r, nd, kind), found in kinds.items():
        code = TYPE_CODES[name] if kind is None else type_code(kind)
        if min(b, c, r) < 0:
            raise RasterError("Dimensions must not be negative")
        index, n = np.array(found), b * c * r
        if wrong := size[index][size[index] != n].tolist():
            raise RasterError(f"Array size {wrong[0]} does not match {b} x {c} x {r}")
        matrix = cells[starts[index][:, None] + np.arange(n)]
        if code != TYPE_CODES[name]:
            matrix = _checked(matrix, code) if DTYPES[code].kind != "f" and matrix.dtype.kind != "f" else convert(matrix.astype(np.float64), code)
        fill(out, Header(0, code, b, c, r, float(nd)), index, matrix, format_code(fmt))
    return pa.array(out, pa.binary())


def _checked(values: np.ndarray, code: int) -> np.ndarray:
    """Whole numbers as another whole type, which must hold them."""
    info = np.iinfo(DTYPES[code])
    if values.size and (int(values.min()) < info.min or int(values.max()) > info.max):
        raise RasterError(f"Value out of range for {TYPES[code][0]}")
    return values.astype(DTYPES[code])


#: (values, data_format, bands, cols, rows, no_data[, type name]) -> cube; the type follows the array's if not named.
rt_array2cube = _define("RT_Array2Cube", _array2cube, T.BinaryType())


def array_type(code: int) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType()) for n in ("data_type", "bands", "cols", "rows")] + [T.StructField("no_data", T.DoubleType()), T.StructField("values", T.ArrayType(_SPARK[TYPES[code][3]]))])


def _elements(values: np.ndarray, code: int) -> pa.Array:
    """Cells as elements of an array type: whole types round half to even and raise beyond their range."""
    to, kind = DTYPES[code], from_spark(_SPARK[TYPES[code][3]])
    if to.kind != "f":
        if values.dtype.kind == "f":
            values = np.rint(values)
            if not np.isfinite(values).all():
                raise RasterError(f"Value out of range for {TYPES[code][0]}")
        values = _checked(values, code)
    if TYPES[code][0] == "UINT64":
        return pa.array([Decimal(x) for x in values.tolist()], kind)
    return pa.array(values.astype(to)).cast(kind)


def _cube2array(code: int):
    kind = array_type(code)
    plain = [f.name for f in kind.fields[:-1]]

    def run(cubes: pa.Array, keep_valid: pa.Array) -> pa.Array:
        size = len(cubes)
        null = _null(cubes, keep_valid)
        heads = {n: np.zeros(size, np.float64 if n == "no_data" else np.int32) for n in plain}
        order, parts, counts = [], [], np.zeros(size, np.int64)
        for head, rows, cells, (only,) in _cases_exact(cubes, keep_valid):
            for n in plain:
                heads[n][rows] = getattr(head, n)
            keep = ~is_nodata(cells.astype(np.float64), head.no_data) if only else np.ones(cells.shape, bool)
            counts[rows] = keep.sum(axis=1)
            order.append(np.repeat(rows, counts[rows]))
            parts.append(_elements(cells[keep], code))
        flat = pa.concat_arrays(parts) if parts else _elements(np.zeros(0), code)
        if len(parts) > 1:  # back to the order of the rows
            flat = flat.take(pa.array(np.argsort(np.concatenate(order), kind="stable")))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        columns = [pa.array(heads[n]) for n in plain] + [pa.ListArray.from_arrays(offsets, flat)]
        return pa.StructArray.from_arrays(columns, [*plain, "values"], mask=pa.array(null)).cast(from_spark(kind))

    return run


def _cases_exact(cubes: pa.Array, *columns: pa.Array):
    """As _cases, with cells in their own type: doubles cannot hold all 64-bit whole numbers."""
    for head, rows, cells, values in _cases(cubes, *columns):
        if DTYPES[head.data_type].kind != "f" and DTYPES[head.data_type].itemsize == 8:
            cells = np.stack([Cube.load(cubes[int(r)].as_py()).values for r in rows])
        yield head, rows, cells, values


rt_cube2array = {name: _define(f"RT_Cube2Array{_TITLES[name]}", _cube2array(code), array_type(code)) for name, code in TYPE_CODES.items()}


def _cube2type(code: int):
    def run(cubes: pa.Array) -> pa.Array:
        out: list = [None] * len(cubes)
        for head, rows, cells, _ in _cases_exact(cubes):
            same = head.data_type == code
            fill(out, replace(head, data_type=code), rows, cells if same else convert(cells.astype(np.float64), code))
        return pa.array(out, pa.binary())

    return run


rt_cube2type = {name: _define(f"RT_Cube2Type{_TITLES[name]}", _cube2type(code), T.BinaryType()) for name, code in TYPE_CODES.items()}


def cube_to_list(cube, kind: str = "DOUBLE") -> Column:
    """The cast of a cube to a list: all cells, nodata included."""
    return rt_cube2array[kind.upper()](cube, F.lit(False))["values"]


# ---- algebra ----


def _unary(name: str):
    return lambda a: to_column(evaluate(("unary", name, ("leaf", 0)), [Batch(a)]), len(a))


def _binary(name: str):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        leaf, kind = _leaf(b)
        return to_column(evaluate(("binary", name, ("leaf", 0), (kind, 1)), [Batch(a), leaf]), len(a))

    return run


def _title(name: str) -> str:
    return "".join(w.capitalize() for w in name.split("_")).replace("Nodata", "NoData")


_algebra = {name: _define(f"RT_Cube{_title(name)}", _unary(name), T.BinaryType()) for name in algebra.UNARY}
_algebra |= {name: _define(f"RT_Cube{_title(name)}", _binary(name), T.BinaryType()) for name in algebra.BINARY_NAMES}
rt_cube_neg, rt_cube_abs, rt_cube_sqrt, rt_cube_log, rt_cube_exp = (_algebra[n] for n in ("neg", "abs", "sqrt", "log", "exp"))
rt_cube_add, rt_cube_subtract, rt_cube_multiply, rt_cube_divide, rt_cube_pow, rt_cube_mod = (_algebra[n] for n in ("add", "subtract", "multiply", "divide", "pow", "mod"))
rt_cube_equal, rt_cube_not_equal, rt_cube_less, rt_cube_less_equal, rt_cube_greater, rt_cube_greater_equal = (_algebra[n] for n in ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal"))
rt_cube_set, rt_cube_set_nodata, rt_cube_fill, rt_cube_min, rt_cube_max = (_algebra[n] for n in ("set", "set_nodata", "fill", "min", "max"))


def _null_or_empty(a: pa.Array) -> pa.Array:
    out = np.ones(len(a), bool)
    for head, rows, cells in Batch(a).groups:
        out[rows] = is_nodata(cells, head.no_data).all(axis=1) if head.cells else True
    return pa.array(out)


rt_cube_null_or_empty = _define("RT_CubeNullOrEmpty", _null_or_empty, T.BooleanType())

# ---- statistics ----


@lru_cache(maxsize=2)
def _masks(shape: bytes, ref: Georef, tiles: tuple[tuple[int, int], ...], cols: int, rows: int) -> np.ndarray:
    """tiles x cells: which cells of some tiles meet a geometry."""
    at = np.array(tiles, np.int64).reshape(-1, 2)
    out = np.zeros((len(at), rows * cols), bool)
    step = max(1, 2_000_000 // max(1, rows * cols))
    for i in range(0, len(at), step):
        part = at[i : i + step]
        out[i : i + step] = geo.cell_masks(geo.parsed(shape), ref.transform, part[:, 0] * ref.block_x, part[:, 1] * ref.block_y, cols, rows).reshape(len(part), -1)
    return out


def _zoned(cubes: pa.Array, tile_x: pa.Array, tile_y: pa.Array, metadata: pa.Array, shape: pa.Array, *columns: pa.Array):
    """_cases of the other columns with the cells that meet each row's geometry: (head, rows, cells, masks, values)."""
    xs, ys, null = _numbers(tile_x, np.int64), _numbers(tile_y, np.int64), _null(tile_x, tile_y)
    for head, rows, cells, (text, zone, *values) in _cases(cubes, metadata, shape, *columns):
        if null[rows].any():
            keep = ~null[rows]
            rows, cells = rows[keep], cells[keep]
        masks = _masks(bytes(zone), georef(text), tuple(zip(xs[rows].tolist(), ys[rows].tolist())), head.cols, head.rows)
        yield head, rows, cells, masks, values


def _states(cubes: pa.Array, band: pa.Array, *zone: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The partial states of all rows as arrays, and which rows have none."""
    out, null = stats.no_states(len(cubes)), np.ones(len(cubes), bool)
    found = ((h, r, c, m, v[0]) for h, r, c, m, v in _zoned(cubes, *zone, band)) if zone else ((h, r, c, None, v[0]) for h, r, c, v in _cases(cubes, band))
    for head, rows, cells, masks, number in found:
        for name, values in stats.partials(_band(head, cells, number), head.no_data, masks).items():
            out[name][rows] = values
        null[rows] = False
    return out, null


def _state_column(*columns: pa.Array) -> pa.Array:
    return stats.struct_of(*_states(*columns), stats.STATE)


def _stats_column(*columns: pa.Array) -> pa.Array:
    states, null = _states(*columns)
    return stats.struct_of(stats.finished_many(states), null, stats.STATS)


_partial_state = _define("RT_CubeState", _state_column, stats.STATE)


def _merge_lists(lists: pa.Array) -> pa.Array:
    """Lists of states -> their statistics; null states are left out, an empty list gives zeros."""
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    states = {name: pc.struct_field(flat, name).fill_null(0).to_numpy(zero_copy_only=False) for name in stats.STATE.names}
    whole = stats.merged_groups(np.repeat(np.arange(len(lists)), n), len(lists), states)
    return stats.struct_of(stats.finished_many(whole), _null(lists), stats.STATS)


_define("RT_CubeStatsMerge", _merge_lists, stats.STATS)


def cube_state(cube, band=0, *zone) -> Column:
    """The partial state that cube_stats_agg merges."""
    return _partial_state(cube, F.lit(band) if isinstance(band, int) else band, *zone)


#: (cube, band[, tile_x, tile_y, metadata, geometry]) -> minimum, maximum, sum, mean, stddev, valid_count, nodata_count
rt_cube_stats = _define("RT_CubeStats", _stats_column, stats.STATS)

# ---- sampling ----


def _sample(cube: Cube, band: int, col: int, row: int, default):
    grid = cube.band(band)
    return float(grid[row, col]) if 0 <= col < cube.head.cols and 0 <= row < cube.head.rows else default


def _sampled(cubes: pa.Array, band: np.ndarray, owner: np.ndarray, col: np.ndarray, row: np.ndarray, default: np.ndarray) -> np.ndarray:
    """The cell at (col, row) of the cube in row `owner` for each of many places, or the default beyond the cube."""
    out = default.copy()
    for head, rows, cells in Batch(cubes).groups:
        place = np.full(len(cubes), -1)
        place[rows] = np.arange(len(rows))
        mine = np.flatnonzero(place[owner] >= 0)
        if len(mine) and (band[mine].min() < 0 or band[mine].max() >= head.bands):
            raise RasterError(f"Band index out of range: {int(band[mine].max())} >= {head.bands}")
        mine = mine[(col[mine] >= 0) & (col[mine] < head.cols) & (row[mine] >= 0) & (row[mine] < head.rows)]
        out[mine] = cells[place[owner[mine]], (band[mine] * head.rows + row[mine]) * head.cols + col[mine]]
    return out


def _one(cubes, band, col, row, default, null) -> pa.Array:
    every = np.flatnonzero(~null)
    found = np.zeros(len(cubes))
    found[every] = _sampled(cubes, _numbers(band, np.int64)[every], every, col[every], row[every], _numbers(default)[every])
    return pa.array(found, pa.float64(), mask=null)


def _raster_value(cubes, band, col, row, default) -> pa.Array:
    return _one(cubes, band, _numbers(col, np.int64), _numbers(row, np.int64), default, _null(cubes, band, col, row, default))


def _listed(cubes, band, xs: pa.Array, ys: pa.Array, default, null: np.ndarray, place, what: str) -> pa.Array:
    """Lists of places: place(owner, x, y) gives their columns and rows."""
    n, m = (np.where(null, 0, pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)) for c in (xs, ys))
    if (n != m).any():
        raise RasterError(f"The lists of {what} must have the same length")
    valid = pa.array(~null)
    x, y = pc.list_flatten(xs.filter(valid)), pc.list_flatten(ys.filter(valid))
    if x.null_count or y.null_count:
        raise RasterError(f"The lists of {what} must not hold NULL")
    owner = np.repeat(np.arange(len(cubes)), n)
    col, row = place(owner, x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False))
    found = _sampled(cubes, _numbers(band, np.int64)[owner], owner, col, row, _numbers(default)[owner])
    offsets = np.concatenate([[0], np.cumsum(n)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found), mask=pa.array(null))


def _raster_values(cubes, band, cols, rows, default) -> pa.Array:
    return _listed(cubes, band, cols, rows, default, _null(cubes, band, cols, rows, default), lambda owner, x, y: (x.astype(np.int64), y.astype(np.int64)), "columns and rows")


def _locate(metadata: pa.Array, owner: np.ndarray, x: np.ndarray, y: np.ndarray, tile: tuple[pa.Array, ...]) -> tuple[np.ndarray, np.ndarray]:
    """World to column and row of the tile (without one: of the raster), by the metadata of each place's owner."""
    col, row = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    texts = metadata.to_pylist()
    kinds: dict[str, list[int]] = {}
    for i, o in enumerate(owner.tolist()):
        kinds.setdefault(texts[o], []).append(i)
    xs, ys = (_numbers(t, np.int64) for t in tile) if tile else (None, None)
    for text, found in kinds.items():
        ref = georef(text)
        col[found], row[found] = ref.pixels(x[found], y[found])
        if tile:
            col[found] -= xs[owner[found]] * ref.block_x
            row[found] -= ys[owner[found]] * ref.block_y
    return col, row


def _coord_value(cubes, band, x, y, metadata, default, *tile) -> pa.Array:
    null = _null(cubes, band, x, y, metadata, default, *tile)
    every = np.flatnonzero(~null)
    col, row = np.zeros(len(cubes), np.int64), np.zeros(len(cubes), np.int64)
    col[every], row[every] = _locate(metadata, every, _numbers(x)[every], _numbers(y)[every], tile)
    return _one(cubes, band, col, row, default, null)


def _coord_values(cubes, band, xs, ys, metadata, default, *tile) -> pa.Array:
    null = _null(cubes, band, xs, ys, metadata, default, *tile)
    return _listed(cubes, band, xs, ys, default, null, lambda owner, x, y: _locate(metadata, owner, x.astype(np.float64), y.astype(np.float64), tile), "x and y")


#: (cube, band, col, row, default): a pixel of the tile
rt_raster_value = _define("RT_RasterValue", _raster_value, T.DoubleType())
rt_raster_values = _define("RT_RasterValues", _raster_values, T.ArrayType(T.DoubleType()))
#: (cube, band, x, y, metadata, default[, tile_x, tile_y]): without a tile the cube must be that of tile (0, 0)
rt_coord_value = _define("RT_CoordValue", _coord_value, T.DoubleType())
rt_coord_values = _define("RT_CoordValues", _coord_values, T.ArrayType(T.DoubleType()))

_TRANSFORM = "struct<transform:array<double>,blocksize_x:int,blocksize_y:int>"


def _value_agg(cube, band, col: Column, row: Column, tile_x, tile_y, ref: Column, default) -> Column:
    tile_x, tile_y = _col(tile_x), _col(tile_y)
    here = (F.floor(col / ref["blocksize_x"]) == tile_x) & (F.floor(row / ref["blocksize_y"]) == tile_y)
    mine = F.when(here, _col(cube))  # other tiles' pixels stay in the JVM
    value = rt_raster_value(mine, F.lit(band) if isinstance(band, int) else band, (col - tile_x * ref["blocksize_x"]).cast("int"), (row - tile_y * ref["blocksize_y"]).cast("int"), F.lit(float("nan")))
    found = F.max(F.when(here, F.struct(value.alias("v"))))["v"]
    return F.when(F.count(F.lit(1)) > 0, F.coalesce(F.when(~F.isnan(found), found), F.lit(float(default))))


def rt_raster_value_agg(cube, band, col, row, tile_x, tile_y, metadata, default: float) -> Column:
    """Aggregate: the value of a pixel of the whole raster, from the group's tile that holds it, else default."""
    return _value_agg(cube, band, _col(col), _col(row), tile_x, tile_y, F.from_json(_col(metadata), _TRANSFORM), default)


def rt_coord_value_agg(cube, band, x, y, tile_x, tile_y, metadata, default: float) -> Column:
    """Aggregate: the value at a place in the world, from the group's tile that holds it, else default."""
    ref = F.from_json(_col(metadata), _TRANSFORM)
    g, dx, dy = ref["transform"], _col(x) - ref["transform"][0], _col(y) - ref["transform"][3]
    det = g[1] * g[5] - g[2] * g[4]
    return _value_agg(cube, band, F.floor((g[5] * dx - g[2] * dy) / det), F.floor((g[1] * dy - g[4] * dx) / det), tile_x, tile_y, ref, default)


# ---- spatial ----


def _positive(band: int, tile_x: int, tile_y: int) -> None:
    if min(band, tile_x, tile_y) < 0:
        raise RasterError("Band and tile indices must not be negative")


def _envelope(cubes, band, tile_x, tile_y, metadata) -> pa.Array:
    out: list = [None] * len(cubes)
    xs, ys, null = _numbers(tile_x, np.int64), _numbers(tile_y, np.int64), _null(tile_x, tile_y)
    for head, rows, cells, (number, text) in _cases(cubes, band, metadata):
        keep = ~is_nodata(_band(head, cells, number), head.no_data).reshape(len(rows), head.rows, head.cols)
        some = np.flatnonzero(keep.any(axis=(1, 2)) & ~null[rows])
        _positive(number, *(int(v[rows[some]].min(initial=0)) for v in (xs, ys)))
        down, across = keep[some].any(axis=2), keep[some].any(axis=1)
        ref, at = georef(text), rows[some]
        g, c, r = ref.transform, xs[at] * ref.block_x, ys[at] * ref.block_y
        left, right = c + across.argmax(axis=1), c + head.cols - across[:, ::-1].argmax(axis=1)
        top, bottom = r + down.argmax(axis=1), r + head.rows - down[:, ::-1].argmax(axis=1)
        corners = [(g[0] + g[1] * a + g[2] * b, g[3] + g[4] * a + g[5] * b) for a in (left, right) for b in (top, bottom)]
        (x0, x1), (y0, y1) = [[f([p[k] for p in corners]) for f in (np.minimum.reduce, np.maximum.reduce)] for k in (0, 1)]
        for i, blob in zip(at.tolist(), geo.ring_wkb(np.stack([x0, y0, x1, y0, x1, y1, x0, y1, x0, y0], axis=1))):
            out[i] = blob
    return pa.array(out, pa.binary())


def _polygon(cubes, band, tile_x, tile_y, metadata) -> pa.Array:
    out: list = [None] * len(cubes)
    xs, ys = tile_x.to_pylist(), tile_y.to_pylist()
    for head, rows, cells, (number, text) in _cases(cubes, band, metadata):
        keep = ~is_nodata(_band(head, cells, number), head.no_data).reshape(len(rows), head.rows, head.cols)
        ref = georef(text)
        for i, mask in zip(rows.tolist(), keep):
            if xs[i] is not None and ys[i] is not None:
                _positive(number, xs[i], ys[i])
                shape = geo.mask_geometry(mask, ref.transform, xs[i] * ref.block_x, ys[i] * ref.block_y)
                out[i] = geo.to_wkb(shape) if shape else None
    return pa.array(out, pa.binary())


def _masked(inside: bool):
    def run(cubes, tile_x, tile_y, metadata, shape, value) -> pa.Array:
        out: list = [None] * len(cubes)
        for head, rows, cells, masks, (new,) in _zoned(cubes, tile_x, tile_y, metadata, shape, value):
            changed = np.tile(masks if inside else ~masks, (1, head.bands))
            fill(out, head, rows, convert(np.where(changed, float(new), cells), head.data_type))
        return pa.array(out, pa.binary())

    return run


#: (cube, band, tile_x, tile_y, metadata) -> WKB
rt_envelope = _define("RT_Envelope", _envelope, T.BinaryType())
rt_polygon = _define("RT_Polygon", _polygon, T.BinaryType())
#: (cube, tile_x, tile_y, metadata, geometry, value) -> cube
rt_cube_clip = _define("RT_CubeClip", _masked(False), T.BinaryType())
rt_cube_burn = _define("RT_CubeBurn", _masked(True), T.BinaryType())


def _measured(of_rings, of_shape):
    """A measure of geometries: rectangles and other polygons of one ring of five points all at once, others one by one."""

    def run(shapes: pa.Array) -> pa.Array:
        out, null = np.zeros(len(shapes)), _null(shapes)
        plain, rings = geo.rings_of(shapes)
        out[plain] = of_rings(rings)
        for i in np.setdiff1d(np.flatnonzero(~null), plain).tolist():
            out[i] = of_shape(geo.parsed(shapes[i].as_py()))
        return pa.array(out, pa.float64(), mask=null)

    return run


def _intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    """Pairs of axis-parallel rectangles all at once, others one by one."""
    null, out = _null(a, b), np.zeros(len(a), bool)
    (ra, boxes_a), (rb, boxes_b) = geo.boxes_of(a), geo.boxes_of(b)
    both, ia, ib = np.intersect1d(ra, rb, return_indices=True)
    p, q = boxes_a[ia], boxes_b[ib]
    out[both] = (p[:, 0] <= q[:, 2]) & (q[:, 0] <= p[:, 2]) & (p[:, 1] <= q[:, 3]) & (q[:, 1] <= p[:, 3])
    for i in np.setdiff1d(np.flatnonzero(~null), both).tolist():
        out[i] = geo.intersects(geo.parsed(a[i].as_py()), geo.parsed(b[i].as_py()))
    return pa.array(out, pa.bool_(), mask=null)


st_area = _define("ST_Area", _measured(geo.ring_areas, geo.area), T.DoubleType())
st_perimeter = _define("ST_Perimeter", _measured(geo.ring_lengths, geo.perimeter), T.DoubleType())
st_intersects = _define("ST_Intersects", _intersects, T.BooleanType())
st_geom_from_text = _define("ST_GeomFromText", _rows(lambda t: geo.to_wkb(geo.from_wkt(t)), T.BinaryType()), T.BinaryType())
st_as_text = _define("ST_AsText", _rows(lambda g: geo.to_wkt(geo.parsed(bytes(g))), T.StringType()), T.StringType())
st_geom_from_geojson = _define("ST_GeomFromGeoJSON", _rows(lambda t: geo.to_wkb(geo.from_geojson(t)), T.BinaryType()), T.BinaryType())
st_as_geojson = _define("ST_AsGeoJSON", _rows(lambda g: geo.to_geojson(geo.parsed(bytes(g))), T.StringType()), T.StringType())
st_transform = _define("ST_Transform", _rows(lambda g, a, b: geo.to_wkb(crs_module.transform_geometry(geo.parsed(bytes(g)), a, b)), T.BinaryType()), T.BinaryType())
st_envelope = _define("ST_Envelope", _rows(lambda g: geo.to_wkb(geo.rectangle(*geo.envelope(geo.parsed(bytes(g))))), T.BinaryType()), T.BinaryType())


def _make_envelope(*columns: pa.Array) -> pa.Array:
    """Rectangles of many rows at once."""
    x0, y0, x1, y1 = (c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in columns)
    rings = np.stack([x0, y1, x1, y1, x1, y0, x0, y0, x0, y1], axis=1)
    null = np.isnan(rings).any(axis=1)
    return pa.array([None if n else blob for n, blob in zip(null, geo.ring_wkb(rings))], pa.binary())


st_make_envelope = _define("ST_MakeEnvelope", _make_envelope, T.BinaryType())


def _make_ring(*columns: pa.Array) -> pa.Array:
    points = np.stack([_numbers(c) for c in columns], axis=1)
    null = _null(*columns)
    return pa.array([None if n else blob for n, blob in zip(null, geo.ring_wkb(np.concatenate([points, points[:, :2]], axis=1)))], pa.binary())


def _make_point(x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array([None if n else blob for n, blob in zip(_null(x, y), geo.point_wkb(_numbers(x), _numbers(y)))], pa.binary())


#: (x, y) of four corners in turn -> the polygon between them
st_make_ring = _define("ST_MakeRing", _make_ring, T.BinaryType())
st_point = _define("ST_Point", _make_point, T.BinaryType())


def bbox_meets(bbox: Column | str, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """A native test of a tile's bbox against a rectangle."""
    b = _col(bbox)
    return (b["xmin"] <= xmax) & (b["xmax"] >= xmin) & (b["ymin"] <= ymax) & (b["ymax"] >= ymin)


# ---- aggregates for SQL text; on tables of any size use cube_stats_agg and the aggregates above ----


def _sql_stats(*columns: pa.Array):
    states, null = _states(*columns)
    whole = stats.merged_groups(np.zeros(int((~null).sum()), np.int64), 1, {k: v[~null] for k, v in states.items()})
    return {k: v[0].item() for k, v in stats.finished_many(whole).items()}


def _sql_value(blob, band, place, tile_x, tile_y, metadata, default):
    value = None
    for b, n, (px, py), tx, ty, m, d in zip(blob, band, place, tile_x, tile_y, metadata, default):
        value = d if value is None else value
        if b is None or m is None:
            continue
        ref = georef(m)
        c, r = (px, py) if isinstance(px, int) else ref.pixel(px, py)
        if (c // ref.block_x, r // ref.block_y) == (tx, ty):
            found = _sample(Cube.load(b), n, c - tx * ref.block_x, r - ty * ref.block_y, None)
            if found is not None:
                return found
    return None if value is None else float(value)


def _sql_raster_value(cube, band, col, row, tile_x, tile_y, metadata, default):
    lists = [c.to_pylist() for c in (cube, band, col, row, tile_x, tile_y, metadata, default)]
    return _sql_value(lists[0], lists[1], [(int(c), int(r)) for c, r in zip(lists[2], lists[3])], *lists[4:])


def _sql_coord_value(cube, band, x, y, tile_x, tile_y, metadata, default):
    lists = [c.to_pylist() for c in (cube, band, x, y, tile_x, tile_y, metadata, default)]
    return _sql_value(lists[0], lists[1], [(float(a), float(b)) for a, b in zip(lists[2], lists[3])], *lists[4:])


def _sql_union(shapes: pa.Array):
    found = [geo.parsed(bytes(s)) for s in shapes.to_pylist() if s is not None]
    return geo.to_wkb(union(found)) if found else None


def union(shapes: list) -> tuple:
    """The union of axis-parallel rectangles, exactly; of disjoint other polygons, their collection."""
    rings = [p for s in shapes for p in geo.polygons(s)]
    square = all(len(p) == 1 and len(p[0]) == 5 and all(a[0] == b[0] or a[1] == b[1] for a, b in zip(p[0], p[0][1:])) for p in rings)
    if not square:
        whole = [("Polygon", p) for p in rings]
        if any(geo.intersects(a, b) for i, a in enumerate(whole) for b in whole[i + 1 :]):
            raise RasterError("The union of polygons that meet is supported for axis-parallel rectangles only")
        return "MultiPolygon", rings
    boxes = [geo.envelope(("Polygon", p)) for p in rings]
    xs, ys = sorted({v for b in boxes for v in (b[0], b[2])}), sorted({v for b in boxes for v in (b[1], b[3])}, reverse=True)
    mask = np.zeros((max(len(ys) - 1, 1), max(len(xs) - 1, 1)), bool)
    for b in boxes:
        mask[ys.index(b[3]) : ys.index(b[1]), xs.index(b[0]) : xs.index(b[2])] = True
    found = [[[(xs[c], ys[r]) for c, r in ring] for ring in rings_] for rings_ in geo.outline(mask)]
    return ("Polygon", found[0]) if len(found) == 1 else ("MultiPolygon", found)


AGGREGATES = {
    "RT_CubeStats_Agg": (_sql_stats, stats.STATS),
    "RT_RasterValue_Agg": (_sql_raster_value, T.DoubleType()),
    "RT_CoordValue_Agg": (_sql_coord_value, T.DoubleType()),
    "ST_Union_Agg": (_sql_union, T.BinaryType()),
}


def st_union_agg(shape) -> Column:
    return F.arrow_udf(_sql_union, T.BinaryType(), F.ArrowUDFType.GROUPED_AGG)(_col(shape))


def rt_gdal_config(spark: SparkSession, key: str, value: str | None) -> bool:
    """Keeps a raster option in the session (or removes it if the value is null); always true.

    read_tiles takes from it GDAL_CACHEMAX (megabytes of decoded blocks that a task keeps of a file) and CPL_DEBUG (ON:
    tasks log each tile that they read, at level INFO of the logger `tilewright`, on their standard error). Other keys
    are kept and have no effect. In SQL text tilewright.sql.run carries the call out.
    """
    if value is None:
        spark.conf.unset(f"spark.tilewright.{key}")
    else:
        spark.conf.set(f"spark.tilewright.{key}", value)
    return True


def register_all(spark: SparkSession) -> None:
    """Formats, functions, aggregates and table functions under their SQL names."""
    from tilewright import sql
    from tilewright.sources.reader import register

    register(spark)
    for name, (run, kind) in REGISTRY.items():
        spark.udf.register(name, F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR))
    for name, (run, kind) in AGGREGATES.items():
        spark.udf.register(name, F.arrow_udf(run, kind, F.ArrowUDFType.GROUPED_AGG))
    sql.register(spark)
