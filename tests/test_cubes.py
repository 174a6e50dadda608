"""The cube value, the nodata rules of the algebra, types, codecs, statistics and sampling."""

import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright import functions as rt
from tilewright.cube import FORMATS, NODATA_UNDEFINED, TYPE_CODES, Batch, Cube, RasterError, convert, is_nodata, is_valid, read_header, retype
from tilewright.operators import algebra, stats
from tilewright.operators.stats import cube_stats_agg
from tilewright.plans.expr import cube

ND = -9999.0


def made(values, nodata=ND, kind="INT32", bands=1, cols=None, rows=1):
    code = TYPE_CODES[kind]
    return Cube.of(convert(np.array(values, float), code), bands, cols or len(values) // rows // bands, rows, nodata, code).dump()


def cells(blob):
    return Cube.load(blob).values.tolist()


def test_layout():
    blob = made([1, 2, 3, 4, 5, 6], nodata=6, cols=2, rows=3)
    assert blob[:2] == b"SR" and len(blob) == 24 + 24
    assert struct.unpack_from("<HBBiiid", blob) == (0x5253, 0, 5, 1, 2, 3, 6.0)


@pytest.mark.parametrize("fmt", ["raw", "Snappy", "gzip", "ZSTD", "lz4", "LZ4_RAW"])
@pytest.mark.parametrize("kind", list(TYPE_CODES))
def test_codecs_and_types(fmt, kind):
    code = TYPE_CODES[kind]
    source = Cube.load(made(range(100), kind=kind, cols=10, rows=10))
    blob = source.dump(FORMATS.get(fmt.upper(), 4))
    back = Cube.load(blob)
    assert back.values.dtype == source.values.dtype and (back.values == source.values).all() and back.head.data_type == code
    assert (Batch(pa.array([blob, None, blob])).groups[0][2] == source.doubles()).all()
    assert Cube.load(Cube.of(np.zeros(0, "<f8"), 0, 0, 0).dump(3)).values.size == 0


@pytest.mark.parametrize("blob", [b"", b"SR", bytes(24), made([1])[:-1]])
def test_broken_cubes(blob):
    with pytest.raises(RasterError):
        Cube.load(blob)


def test_no_cube():
    with pytest.raises(RasterError, match="Cannot convert NULL blob"):
        read_header(None)
    with pytest.raises(RasterError):
        Cube.of(np.zeros(5), 1, 2, 3)
    with pytest.raises(RasterError):
        Cube.of(np.zeros(6), -1, -2, 3)


def test_nodata_predicates():
    v = np.array([1.0, math.nan, math.inf, -math.inf, ND])
    assert is_nodata(v, ND).tolist() == [False, False, False, False, True]
    assert is_nodata(v, math.nan).tolist() == [False, True, False, False, False]
    assert is_valid(v, ND).tolist() == [True, False, False, False, False]
    assert is_valid(v, math.nan).tolist() == [True, False, False, False, True]


BOTH = [(6.0, 4.0), (ND, 4.0), (6.0, ND), (math.nan, 4.0), (6.0, math.inf), (-7.0, 2.0), (5.0, 0.0)]
WANT = {
    "add": [10, ND, 6, math.nan, 6, -5, 5],
    "subtract": [2, ND, 6, math.nan, 6, -9, 5],
    "multiply": [24, ND, 6, math.nan, 6, -14, 0],
    "divide": [1.5, ND, 6, math.nan, 6, -3.5, 5],
    "pow": [1296, ND, 6, math.nan, 6, 49, 1],
    "mod": [2, ND, 6, math.nan, 6, -1, math.nan],
    "equal": [0, ND, 6, math.nan, 6, 0, 0],
    "not_equal": [1, ND, 6, math.nan, 6, 1, 1],
    "less": [0, ND, 6, math.nan, 6, 1, 0],
    "less_equal": [0, ND, 6, math.nan, 6, 1, 0],
    "greater": [1, ND, 6, math.nan, 6, 0, 1],
    "greater_equal": [1, ND, 6, math.nan, 6, 0, 1],
    "set": [4, ND, 6, math.nan, 6, 2, 0],
    "fill": [4, 4, ND, 4, math.inf, 2, 0],
    "min": [4, ND, 6, math.nan, 6, -7, 0],
    "max": [6, ND, 6, math.nan, 6, 2, 5],
}


@pytest.mark.parametrize("name", list(WANT))
def test_binary_truth_table(name):
    a, b = (np.array([x]) for x in zip(*BOTH))
    head = read_header(made([0] * len(BOTH), kind="DOUBLE"))
    out_head, out = algebra.binary(name, head, a, head, b)
    np.testing.assert_array_equal(out[0], WANT[name])
    assert out_head.data_type == TYPE_CODES["DOUBLE"] and out_head.no_data == ND
    for i, (x, y) in enumerate(BOTH):  # a scalar has no nodata value
        if y != ND:
            np.testing.assert_array_equal(algebra.binary(name, head, np.array([[x] * len(BOTH)]), None, np.array([[y]]))[1][0, 0], WANT[name][i])


def test_unary_truth_table():
    head = read_header(made([0] * 5, kind="DOUBLE"))
    a = np.array([[4.0, ND, math.nan, -4.0, 0.0]])
    for name, want in {"neg": [-4, ND, math.nan, 4, -0.0], "abs": [4, ND, math.nan, 4, 0], "sqrt": [2, ND, math.nan, math.nan, 0], "log": [math.log(4), ND, math.nan, math.nan, -math.inf], "exp": [math.exp(4), ND, math.nan, math.exp(-4), 1]}.items():
        np.testing.assert_allclose(algebra.unary(name, head, a)[1][0], want)


def test_type_change_clamps_and_cuts():
    big = [1e300, -1e300, 3.9, -3.9, math.nan, math.inf]
    assert convert(np.array(big), TYPE_CODES["UINT8"]).tolist() == [255, 0, 3, 0, 0, 255]
    assert convert(np.array(big), TYPE_CODES["INT64"]).tolist() == [2**63 - 1, -(2**63), 3, -3, 0, 2**63 - 1]
    assert convert(np.array(big), TYPE_CODES["UINT64"]).tolist()[:2] == [2**64 - 1, 0]
    assert math.isnan(convert(np.array(big), TYPE_CODES["FLOAT"])[4]) and convert(np.array(big), TYPE_CODES["FLOAT"])[5] == np.finfo("f4").max
    kept = Cube.load(made([ND, 5]))
    assert retype(kept, TYPE_CODES["UINT8"]).head.no_data == ND and retype(kept, kept.head.data_type) is kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6) | st.just(ND) | st.just(math.nan), min_size=1, max_size=60), st.integers(0, 60))
def test_merged_statistics(values, at):
    v = np.array(values)
    whole = stats.finished(stats.partial(v, ND))
    parts = stats.finished(stats.merged(stats.partial(v[:at], ND), stats.partial(v[at:], ND)))
    for k in whole:
        assert parts[k] == pytest.approx(whole[k], rel=1e-9, abs=1e-6)
    assert whole["valid_count"] + whole["nodata_count"] == len(values)


def test_column_functions(spark):
    lit = F.lit
    arr = lambda v, fmt="RAW", nd=6.0, c=2, r=3: rt.rt_array2cube(F.array(*map(lit, v)), lit(fmt), lit(1), lit(c), lit(r), lit(nd))
    df = spark.range(1).select(arr([1, 2, 3, 4, 5, 6]).alias("a"), arr([1, 2, 3, 4, 5, 6], nd=ND).alias("b"), lit(None).cast("binary").alias("n"))
    ints = lambda c, keep=False: rt.rt_cube2array["INT32"](c, lit(keep))["values"]
    row = df.select(
        F.array_max(ints("a")).alias("top"), F.array_max(ints("a", True)).alias("top_valid"), ints(rt.rt_cube_add("b", "b")).alias("sum"), rt.rt_cube2array["FLOAT"](rt.rt_cube_add("b", lit(1.5)), lit(False))["values"].alias("plus"),
        ints(rt.rt_cube_equal("b", "b")).alias("eq"), ints(rt.rt_cube_subtract("b", "b")).alias("minus"), ints(rt.rt_cube_greater("b", "b")).alias("gt"), ints(rt.rt_cube_greater_equal("b", "b")).alias("ge"), rt.cube_to_list("a", "INT32").alias("cast"),
        rt.rt_cube_null_or_empty("n").alias("none"), rt.rt_cube_null_or_empty("a").alias("some"), rt.rt_cube_add("n", "a").alias("null_add"), rt.rt_cube_stats("a", lit(0)).alias("s"), rt.rt_raster_value("b", lit(0), lit(10000), lit(1), lit(ND)).alias("out"),
        rt.rt_raster_values("b", lit(0), F.array(lit(0), lit(1)), F.array(lit(0), lit(2)), lit(ND)).alias("many"), rt.rt_raster_values("b", lit(0), F.array().cast("array<int>"), F.array().cast("array<int>"), lit(ND)).alias("no_places"),
        (cube("b") * 2.0 + cube("b")).column().alias("fused"), (cube("b") * F.lit(3)).column("zstd").alias("scaled"), rt.rt_cube_set_nodata("a", lit(1.0)).alias("retagged"),
    ).first()
    assert (row.top, row.top_valid) == (6, 5)
    assert row["sum"] == [2, 4, 6, 8, 10, 12] and row.plus == [2.5, 3.5, 4.5, 5.5, 6.5, 7.5]
    assert row.eq == [1] * 6 and row.minus == [0] * 6 and row.gt == [0] * 6 and row.ge == [1] * 6 and row.cast == [1, 2, 3, 4, 5, 6]
    assert row.none and not row.some and row.null_add is None
    assert (row.s.minimum, row.s.maximum, row.s.valid_count, row.s.nodata_count) == (1, 5, 5, 1)
    assert row.out == ND and row.many == [1.0, 6.0] and row.no_places == []
    assert cells(row.fused) == [3, 6, 9, 12, 15, 18] and cells(row.scaled) == [3, 6, 9, 12, 15, 18]
    assert read_header(row.retagged).no_data == 1.0 and read_header(row.retagged).data_type == TYPE_CODES["DOUBLE"]


def test_errors_reach_the_user(spark):
    df = spark.range(1).select(F.lit(bytearray(made([1, 2]))).alias("a"), F.lit(bytearray(made([1, 2, 3]))).alias("b"))
    for column, said in ((rt.rt_raster_value("a", F.lit(10000), F.lit(0), F.lit(0), F.lit(0.0)), "Band index out of range: 10000 >= 1"), (rt.rt_cube_add("a", "b"), "different dimensions"), (rt.rt_cube2array["UINT8"](rt.rt_cube_add("a", F.lit(300.0)), F.lit(False)), "out of range"), (rt.rt_envelope("a", F.lit(0), F.lit(-1), F.lit(0), F.lit("{}")), "negative"), (rt.rt_envelope("a", F.lit(0), F.lit(0), F.lit(0), F.lit("{}")), "transform")):
        with pytest.raises(Exception, match=said):
            df.select(column).collect()


def test_mixed_shapes_and_nulls_in_a_batch(spark):
    rows = [(1, made([1, 2])), (2, None), (3, made([5, 6, 7], nodata=7)), (4, made([3, 4], kind="FLOAT")), (5, Cube.of(np.zeros(0, "<f8"), 0, 0, 0).dump())]
    df = spark.createDataFrame([(i, bytearray(b) if b else None) for i, b in rows], "i int, a binary").coalesce(1)
    out = {r.i: r.v for r in df.select("i", (cube("a") + cube("a")).column().alias("v")).collect()}
    assert [cells(out[i]) if out[i] else None for i in (1, 2, 3, 4, 5)] == [[2, 4], None, [10, 12, 7], [6, 8], []]


def test_statistics_do_not_depend_on_tiling(spark):
    rng = np.random.default_rng(1)
    grid = rng.normal(50, 9, (24, 36))
    grid[rng.random(grid.shape) < 0.2] = ND
    want = stats.finished(stats.partial(grid.ravel(), ND))
    for block in (1, 5, 12, 36):
        tiles = [(bytearray(Cube.of(grid[y : y + block, x : x + block].copy().ravel(), 1, min(block, 36 - x), min(block, 24 - y), ND).dump()), x // block) for y in range(0, 24, block) for x in range(0, 36, block)]
        df = spark.createDataFrame(tiles, "c binary, g int").repartition(3)
        got = cube_stats_agg(df, [], "c").first().stats
        for k, v in want.items():
            assert got[k] == pytest.approx(v)
    assert cube_stats_agg(df.limit(0), [], "c").first().stats.valid_count == 0


def test_value_aggregates(spark):
    meta = '{"transform": [100.0, 2.0, 0.0, 50.0, 0.0, -2.0], "blocksize_x": 2, "blocksize_y": 2}'
    tiles = [(x, y, bytearray(made([10 * y + x] * 4, cols=2, rows=2)), meta) for x in range(3) for y in range(3)]
    df = spark.createDataFrame(tiles, "tile_x int, tile_y int, c binary, m string").repartition(4)
    args = ("tile_x", "tile_y", "m", -1.0)
    row = df.agg(rt.rt_raster_value_agg("c", 0, F.lit(5), F.lit(2), *args).alias("a"), rt.rt_coord_value_agg("c", 0, F.lit(103.0), F.lit(41.0), *args).alias("b"), rt.rt_raster_value_agg("c", 0, F.lit(500), F.lit(2), *args).alias("far")).first()
    assert (row.a, row.b, row.far) == (12.0, 20.0, -1.0)
    assert df.limit(0).agg(rt.rt_raster_value_agg("c", 0, F.lit(5), F.lit(2), *args).alias("a")).first().a is None


def test_undefined_nodata():
    assert NODATA_UNDEFINED == -np.finfo(float).max


def test_band_algebra_as_text(spark):
    from tilewright.plans.expr import parse

    df = spark.createDataFrame([(bytearray(made([4, 9, ND])), bytearray(made([1, 2, 3])))], "a binary, b binary")
    for text, want in (("(a - b) / (a + b)", [0.6, 7 / 11, ND]), ("max(sqrt(a), 2.5) ^ 2", [6.25, 9, ND]), ("-a % 3", [-1, 0, ND]), ("a > 4", [0, 1, ND]), ("type(a * 100, uint8)", [255, 255, 0])):
        assert cells(df.select(parse(text).column().alias("v")).first().v) == pytest.approx(want)
    for wrong in ("1 + a", "a +", "foo(a)", "a.b", "a < b < a"):
        with pytest.raises(RasterError):
            parse(wrong)
