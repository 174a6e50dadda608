"""Grids, files, mosaics, warping, the data sources and the sink."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright import functions as rt
from tilewright.cube import NODATA_UNDEFINED, TYPE_CODES, Cube, RasterError
from tilewright.geo.geometry import area, from_wkb
from tilewright.sources import tiff
from tilewright.sources.create import create, drivers
from tilewright.sources.dataset import Mosaic, Warped, open_file, open_raster, warp_options
from tilewright.sources.grid import Georef, Grid
from tilewright.sources.png import PngRaster, write_png
from tilewright.sources.reader import Options, Scan, read_tiles
from tilewright.sources.writer import write_raster
from tilewright.sql import run

SAMPLE = dict(crs="EPSG:25830", xmin=499980.0, ymin=4789760.0, xmax=510220.0, ymax=4800000.0, width=2048, height=2048, num_bands=1, data_type=3, nodata=-9999.0)
# Fixed value: the metadata text of the sample raster in blocks of 128.
METADATA = (
    '{"file_format": "raster", "version": "0.1.0", "data_format": "RAW", "datacube": false, "crs": "EPSG:25830", "transform": [499980.000000, 5.000000, 0.000000, 4800000.000000, 0.000000, -5.000000], '
    '"bounds": [499980.000000, 4789760.000000, 510220.000000, 4800000.000000], "geometry": "POLYGON((499980.000000 4800000.000000, 510220.000000 4800000.000000, 510220.000000 4789760.000000, 499980.000000 4789760.000000, 499980.000000 4800000.000000))", '
    '"width": 2048, "height": 2048, "blocksize_x": 128, "blocksize_y": 128, "band_count": 1, "bands": [{"name": "databand_1", "description": "", "type_name": "Int16", "data_type": 3, "data_size": 2, "width": 128, "height": 128, "colorinterp": 0, "nodata": -9999.000000, "scale": null, "offset": null, "unit": ""}]}'
)


def raster(path, cells, nodata=NODATA_UNDEFINED, scheme="NONE", block=16, crs="EPSG:25830", transform=(545539.75, 0.5, 0.0, 4724510.25, 0.0, -0.5), skip=()):
    bands, height, width = cells.shape
    with open(path, "wb+") as f:
        out = tiff.TiffWriter(f, width, height, bands, cells.dtype, nodata, crs, transform, scheme, block, ["b"] * bands)
        for y in range(out.down):
            for x in range(out.across):
                for b in range(bands):
                    part = np.zeros((block, block), cells.dtype)
                    own = cells[b, y * block : (y + 1) * block, x * block : (x + 1) * block]
                    part[: own.shape[0], : own.shape[1]] = own
                    if (x, y) not in skip:
                        out.write(b, x, y, part)
        out.close()
    return str(path)


@pytest.fixture(scope="module")
def overlay(tmp_path_factory):
    cells = np.random.default_rng(1).integers(0, 256, (3, 180, 320)).astype("u1")
    return raster(tmp_path_factory.mktemp("r") / "overlay.tif", cells, block=64), cells


def test_create(spark):
    small = create(spark, "m", **SAMPLE, blocksize_x=128, blocksize_y=128)
    assert small.count() == 256 and small.first().metadata == METADATA
    assert Cube.load(bytes(small.first().databand_1)).values.tolist() == [-9999] * 128 * 128
    odd = create(spark, "m", **{**SAMPLE, "num_bands": 2}, blocksize_x=1000, blocksize_y=900, datacube=True, data_format="zstd").orderBy("id").collect()
    assert [(r.cols, r.rows) for r in odd[:3]] == [(1000, 900), (1000, 900), (48, 900)] and len(odd) == 9
    assert all(Cube.load(bytes(r.datacube)).head.bands == 2 and area(from_wkb(bytes(r.geometry))) == 25 * r.cols * r.rows for r in odd)
    for wrong in ({"crs": ""}, {"num_bands": 0}, {"width": 0}, {"data_type": 14}, {"driver_name": "none"}, {"blocksize_x": 0}, {"data_format": "none"}):
        with pytest.raises(RasterError):
            create(spark, "m", **{**SAMPLE, **wrong})


def test_create_file(spark, tmp_path):
    path = str(tmp_path / "new.tif")
    assert create(spark, path, **SAMPLE, driver_name="Gtiff", blocksize_x=512, blocksize_y=512).count() == 16
    got = open_file(path)
    assert (got.width, got.height, got.nodata, got.crs) == (2048, 2048, -9999.0, "EPSG:25830") and got.empty(0, 0, 100, 100)
    assert read_tiles(spark, path).count() == 0 and (got.read(0, 5, 5, 3, 3) == -9999).all()
    assert read_tiles(spark, path, skip_empty_tiles=False, blocksize_x=1024, blocksize_y=1024).count() == 4


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_lzw(data, times):
    assert tiff.lzw_decode(tiff.lzw_encode(data * times)) == data * times


@pytest.mark.parametrize("scheme", ["NONE", "LZW", "DEFLATE", "ZSTD"])
@pytest.mark.parametrize("kind", ["u1", "i1", "u2", "i2", "u4", "i4", "u8", "i8", "f4", "f8"])
def test_tiff_round_trip(tmp_path, scheme, kind):
    cells = (np.random.default_rng(2).normal(0, 60, (2, 37, 50))).astype(kind)
    got = open_file(raster(tmp_path / "a.tif", cells, nodata=-5.5 if kind[0] == "f" else 7, scheme=scheme))
    assert (got.width, got.height, got.bands, got.crs) == (50, 37, 2, "EPSG:25830")
    assert got.descriptions == ["b", "b"] and got.transform == (545539.75, 0.5, 0.0, 4724510.25, 0.0, -0.5)
    for b in range(2):
        assert (got.read(b, 0, 0, 50, 37) == cells[b]).all() and (got.read(b, 13, 9, 20, 11) == cells[b, 9:20, 13:33]).all()


def plain_tiff(order, cells, compression=1, predictor=1, rows_per_strip=5, planar=1):
    """A classic file in strips."""
    height, width, bands = cells.shape
    cells = cells.astype(cells.dtype.newbyteorder(order))
    strips = []
    for plane in range(bands if planar == 2 else 1):
        part = cells[:, :, plane : plane + 1] if planar == 2 else cells
        for y in range(0, height, rows_per_strip):
            rows = part[y : y + rows_per_strip]
            if predictor == 2:
                rows = np.concatenate([rows[:, :1], np.diff(rows.astype(rows.dtype.newbyteorder("=")), axis=1)], axis=1).astype(cells.dtype)
            data = rows.tobytes()
            if predictor == 3:
                size = cells.dtype.itemsize
                big = rows.astype(rows.dtype.newbyteorder(">")).tobytes()
                flat = np.frombuffer(big, "u1").reshape(rows.shape[0], -1, size).transpose(0, 2, 1).reshape(rows.shape[0], -1)
                data = np.concatenate([flat[:, :1], np.diff(flat, axis=1)], axis=1).astype("u1").tobytes()
            if compression == 8:
                data = zlib.compress(data)
            elif compression == 32773:
                data = b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))
            strips.append(data)
    kind = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [8 * cells.dtype.itemsize] * bands), (259, "H", [compression]), (262, "H", [1]), (273, "I", None), (277, "H", [bands]), (278, "I", [rows_per_strip]), (279, "I", [len(s) for s in strips]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [kind] * bands)]
    head = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)
    at = 8 + 2 + 12 * len(tags) + 4
    sizes = {"H": 2, "I": 4}
    room = sum(n for _, f, v in tags if (n := sizes[f] * (len(strips) if v is None else len(v))) > 4)
    places, place = [], at + room
    for s in strips:
        places.append(place)
        place += len(s)
    body, tail = struct.pack(order + "H", len(tags)), b""
    for tag, f, values in tags:
        values = places if values is None else values
        data = struct.pack(f"{order}{len(values)}{f}", *values)
        body += struct.pack(order + "HHI", tag, 3 if f == "H" else 4, len(values))
        if len(data) <= 4:
            body += data.ljust(4, b"\0")
        else:
            body += struct.pack(order + "I", at + len(tail))
            tail += data
    return head + body + struct.pack(order + "I", 0) + tail + b"".join(strips)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("how", [(1, 1), (8, 1), (8, 2), (32773, 1), (8, 3)])
@pytest.mark.parametrize("planar", [1, 2])
def test_plain_tiff(tmp_path, order, how, planar):
    kind = "f4" if how[1] == 3 else "u2"
    if how[1] == 3 and planar == 1:
        cells = np.random.default_rng(3).normal(0, 1e3, (13, 21, 1)).astype(kind)
    else:
        cells = (np.random.default_rng(3).normal(500, 90, (13, 21, 2))).astype(kind)
    path = tmp_path / "p.tif"
    path.write_bytes(plain_tiff(order, cells, *how, planar=planar))
    got = open_file(str(path))
    assert (got.block_x, got.block_y, got.transform, got.crs) == (21, 5, None, "")
    for b in range(cells.shape[2]):
        assert (got.read(b, 0, 0, 21, 13) == cells[:, :, b]).all()


@pytest.mark.parametrize("kind,bands", [("u1", 1), ("u1", 3), ("u2", 4), ("u2", 2)])
def test_png(tmp_path, kind, bands):
    cells = np.random.default_rng(4).integers(0, np.iinfo(kind).max, (9, 14, bands)).astype(kind)
    with open(tmp_path / "a.png", "wb") as f:
        write_png(f, cells)
    got = open_file(str(tmp_path / "a.png"))
    assert all((got.read(b, 2, 1, 5, 6) == cells[1:7, 2:7, b]).all() for b in range(bands))


def test_png_filters(tmp_path):
    cells = np.random.default_rng(5).integers(0, 256, (5, 7, 3)).astype("u1")
    step, lines, before = 3, b"", np.zeros(21, int)
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line = cells[y].ravel().astype(int)
        left, corner = np.concatenate([np.zeros(step, int), line[:-step]]), np.concatenate([np.zeros(step, int), before[:-step]])
        p = left + before - corner
        near = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        lines += bytes([kind]) + ((line - (0, left, before, (left + before) // 2, near)[kind]) % 256).astype("u1").tobytes()
        before = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    (tmp_path / "f.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
    assert (PngRaster(str(tmp_path / "f.png")).cells == cells).all()


def test_tile_scan(spark, overlay):
    path, cells = overlay
    t = read_tiles(spark, path, blocksize_x=320, blocksize_y=8).orderBy("id").collect()
    assert len(t) == 23 and t[-1].rows == 4 and t[-1].id == 22 and area(from_wkb(bytes(t[-1].geometry))) == 320.0
    assert (t[0].bbox.xmin, t[0].bbox.ymax, t[0].x) == (545539.75, 4724510.25, 545619.75)
    assert all((Cube.load(bytes(r[f"databand_{b + 1}"])).values.reshape(r.rows, r.cols) == cells[b, 8 * r.tile_y : 8 * r.tile_y + r.rows]).all() for r in t for b in range(3))
    one = read_tiles(spark, path, blocksize_x=512, blocksize_y=512, datacube=True, data_format="gzip", bands=[3, 1]).first()
    assert (Cube.load(bytes(one.datacube)).values.reshape(2, 180, 320) == cells[[2, 0]]).all() and json.loads(one.metadata)["datacube"] is True
    for wrong in ({"blocksize_x": 0}, {"data_format": "x"}, {"bands": [4]}):
        with pytest.raises(Exception):
            read_tiles(spark, path, **wrong).collect()
    with pytest.raises(Exception, match="Could not open file"):
        read_tiles(spark, path + ".none")


def test_pruning_reads_fewer_tiles(spark, overlay):
    path, _ = overlay
    whole = read_tiles(spark, path, blocksize_x=32, blocksize_y=32)
    cut = read_tiles(spark, path, blocksize_x=32, blocksize_y=32, where=[("tile_x", ">", 2), ("tile_x", "<=", 5), ("bbox.ymax", "<", 4724500.0), ("id", "in", [13, 14, 24, 25, 99])])
    want = whole.where("tile_x > 2 and tile_x <= 5 and bbox.ymax < 4724500.0 and id in (13, 14, 24, 25, 99)")
    assert sorted(r.id for r in cut.select("id").collect()) == sorted(r.id for r in want.select("id").collect())
    box = (545600.0, 4724450.0, 545640.0, 4724470.0)
    assert read_tiles(spark, path, bbox=box, blocksize_x=32, blocksize_y=32).count() == whole.where(rt.bbox_meets("bbox", *box)).count() > 0
    assert read_tiles(spark, path, where=[("id", "<", 0)]).count() == 0


def test_cell_scan(spark, overlay, tmp_path):
    path, cells = overlay
    c = read_tiles(spark, path, cells=True, blocksize_x=100, blocksize_y=70)
    got = c.toPandas().sort_values("id")
    assert got.id.tolist() == list(range(57600))
    assert (got.band_2.to_numpy() == cells[1][got.row.to_numpy(), got.col.to_numpy()]).all()
    first = got.iloc[0]
    assert (first.x, first.y, from_wkb(bytes(first.geometry))) == (545540.0, 4724510.0, ("Point", (545540.0, 4724510.0)))
    holes = np.full((2, 4, 4), 7, "f4")
    holes[0, 0, :2] = -1
    holes[1, 0, 1:3] = -1
    hole = raster(tmp_path / "h.tif", holes, nodata=-1.0)
    assert [read_tiles(spark, hole, cells=True, ignore_nodata=n).count() for n in (0, 1, 2)] == [16, 13, 15]
    with pytest.raises(Exception, match="ignore_nodata"):
        read_tiles(spark, hole, cells=True, ignore_nodata=3)


def test_large_whole_types(spark, tmp_path):
    cells = np.array([[[0, 2**64 - 1], [5, 2**63]]], "u8")
    got = read_tiles(spark, raster(tmp_path / "u.tif", cells), cells=True).orderBy("id").collect()
    assert [int(r.band_1) for r in got] == [0, 2**64 - 1, 5, 2**63]


def clips(folder, rng):
    """Four parts of a raster that overlap, with nodata at random; later ones lie on top."""
    parts = {}
    for name, (x, y, w, h) in {"00": (0, 0, 30, 40), "01": (24, 0, 40, 40), "10": (0, 35, 30, 22), "11": (24, 35, 40, 22)}.items():
        cells = rng.integers(0, 20, (1, h, w)).astype("i2")
        cells[rng.random(cells.shape) < 0.3] = -9999
        parts[name] = (x, y, cells)
        raster(folder / f"clip{name}.tif", cells, nodata=-9999, crs="EPSG:32630", transform=(541020.0 + 20 * x, 20.0, 0.0, 4796640.0 - 20 * y, 0.0, -20.0))
    whole = np.full((57, 64), -9999, "i2")
    for name in sorted(parts):
        x, y, cells = parts[name]
        part = whole[y : y + cells.shape[1], x : x + cells.shape[2]]
        part[cells[0] != -9999] = cells[0][cells[0] != -9999]
    return whole, parts


def test_mosaic_list_pattern_and_virtual_file(spark, tmp_path):
    whole, parts = clips(tmp_path, np.random.default_rng(6))
    sources = "".join(
        f'<ComplexSource resampling="nearest"><SourceFilename relativeToVRT="1">clip{n}.tif</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff="0" yOff="0" xSize="{c.shape[2]}" ySize="{c.shape[1]}" /><DstRect xOff="{x}" yOff="{y}" xSize="{c.shape[2]}" ySize="{c.shape[1]}" /><NODATA>-9999</NODATA></ComplexSource>'
        for n, (x, y, c) in sorted(parts.items())
    )
    (tmp_path / "m.vrt").write_text(f'<VRTDataset rasterXSize="64" rasterYSize="57"><SRS>PROJCS["UTM",AUTHORITY["EPSG","32630"]]</SRS><GeoTransform>541020, 20, 0, 4796640, 0, -20</GeoTransform><VRTRasterBand dataType="Int16" band="1"><NoDataValue>-9999</NoDataValue>{sources}</VRTRasterBand></VRTDataset>')
    listed = [str(tmp_path / f"clip{n}.tif") for n in sorted(parts)]
    for path in (listed, str(tmp_path / "clip*.tif"), str(tmp_path / "m.vrt")):
        c = read_tiles(spark, path, cells=True).toPandas()
        out = np.zeros((57, 64), "i2")
        out[c.row, c.col] = c.band_1
        assert (out == whole).all()
    assert read_tiles(spark, str(tmp_path / "m.vrt")).first().metadata.count("EPSG:32630") == 1
    with pytest.raises(RasterError):
        open_raster([])
    with pytest.raises(RasterError):
        open_raster([str(tmp_path / "clip*.tif")])
    with pytest.raises(RasterError):
        open_raster(str(tmp_path / "none*.tif"))
    stack = open_raster([listed[0], listed[1]], separate=True)
    assert stack.bands == 2 and (stack.read(0, 0, 0, 30, 40) == parts["00"][2][0]).all() and (stack.read(1, 24, 0, 40, 40) == parts["01"][2][0]).all()
    assert (stack.read(1, 0, 0, 24, 40) == -9999).all()
    with pytest.raises(RasterError, match="coordinate system"):
        Mosaic([open_file(listed[0]), Warped(open_file(listed[1]), warp_options(["-t_srs", "EPSG:4326"]))])


def test_warp(spark, overlay):
    path, cells = overlay
    same = read_tiles(spark, path, cells=True, warp_options=[])
    assert same.count() == 57600
    w = read_tiles(spark, path, cells=True, warp_options=["-t_srs", "EPSG:4326", "-r", "nearest"]).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    assert [round(v, 4) for v in w] == [-2.4442, 42.6709, -2.4423, 42.6717]
    source = open_file(path)
    half = Warped(source, warp_options(["-tr", "1", "1", "-r", "bilinear", "-te", "545539.75", "4724420.25", "545699.75", "4724510.25"]))
    assert (half.width, half.height) == (160, 90)
    assert half.read(0, 3, 4, 1, 1)[0, 0] == np.rint(cells[0, 8:10, 6:8].mean())
    again = Warped(Warped(source, warp_options(["-t_srs", "EPSG:3035", "-tr", "0.1", "0.1", "-dstnodata", "0"])), warp_options(["-t_srs", "EPSG:25830", "-tr", "0.5", "0.5", "-te", "545539.75", "4724420.25", "545699.75", "4724510.25"]))
    assert (again.read(0, 20, 20, 100, 100) == cells[0, 20:120, 20:120]).mean() > 0.97
    for wrong in (["-cutline", "x"], ["-r", "cubic"], ["-tr", "1"], ["-t_srs", "EPSG:2154"]):
        with pytest.raises(RasterError):
            Warped(source, warp_options(wrong))


@pytest.mark.parametrize("driver,options", [("GTiff", {}), ("gtiff", {"creation_options": ["COMPRESS=ZSTD", "BLOCKSIZE=64"]}), ("COG", {"creation_options": ["COMPRESS=LZW"]}), ("PNG", {"creation_options": ["WORLDFILE=YES"]})])
def test_write_and_read(spark, overlay, tmp_path, driver, options):
    path, cells = overlay
    out = str(tmp_path / ("o.png" if driver == "PNG" else "o.tif"))
    t = read_tiles(spark, path, blocksize_x=48, blocksize_y=48).repartition(3)
    assert write_raster(t, out, driver=driver, srs="EPSG:25830", databand_columns=["databand_3", "databand_2", "databand_1"], envelope=[545539.75, 4724420.25, 545699.75, 4724510.25], **options) == t.count()
    got = open_file(out)
    assert got.transform == (545539.75, 0.5, 0.0, 4724510.25, 0.0, -0.5)
    assert all((got.read(b, 0, 0, 320, 180) == cells[2 - b]).all() for b in range(3))
    assert not [p for p in tmp_path.iterdir() if "spool" in p.name or "part" in p.name]


def test_write_envelopes_and_errors(spark, tmp_path):
    cells = np.full((1, 20, 20), -1, "i4")
    cells[0, 5:9, 12:15] = 8
    t = read_tiles(spark, raster(tmp_path / "a.tif", cells, nodata=-1, transform=(0.0, 1.0, 0.0, 20.0, 0.0, -1.0)), blocksize_x=7, blocksize_y=7)
    out = str(tmp_path / "o.tif")
    write_raster(t, out, compute_valid_envelope=True, envelope=[0, 0, 1, 1])
    got = open_file(out)
    assert (got.width, got.height, got.transform[0], got.transform[3]) == (3, 4, 12.0, 15.0) and (got.read(0, 0, 0, 3, 4) == 8).all()
    write_raster(t, out, envelope=[-5, 10, 15, 30])
    got = open_file(out)
    assert (got.width, got.height) == (20, 20) and got.read(0, 17, 15, 1, 1)[0, 0] == 8 and got.read(0, 0, 0, 1, 1)[0, 0] == -1
    assert write_raster(t.limit(0), str(tmp_path / "none.tif")) == 0 and not (tmp_path / "none.tif").exists()
    for wrong in ({"nonsense": 1}, {"driver": "none"}, {"databand_columns": ["x"]}, {"geometry_column": "x"}, {"resampling": "cubic"}, {"databand_columns": ["x1"]}):
        with pytest.raises(Exception):
            write_raster(t.withColumn("x1", F.lit(1)), out, **wrong)


def test_sql_text(spark, overlay):
    path, cells = overlay
    rt.register_all(spark)
    one = lambda q: spark.sql(q).first()
    assert one(f"SELECT count(*) FROM RT_Read('{path}', blocksize_x => 320, blocksize_y => 8)")[0] == 23
    assert one(f"SELECT count(*) FROM RT_ReadCells(array('{path}', '{path}'), separate_bands => true) WHERE band_1 = band_2")[0] == 57600
    got = one(f"SELECT RT_CubeStats_Agg(RT_Cube2TypeFloat(RT_CubeDivide(RT_CubeSubtract(databand_1, databand_2), 2.0D)), 0) FROM RT_Read('{path}')")[0]
    assert got.mean == pytest.approx(((cells[0].astype(float) - cells[1]) / 2).mean()) or got.nodata_count
    assert one(f"SELECT RT_RasterValue_Agg(databand_1, 0, 100, 90, tile_x, tile_y, metadata, -1.0D) FROM RT_Read('{path}', blocksize_x => 64, blocksize_y => 64)")[0] == cells[0, 90, 100]
    assert one("SELECT RT_GdalConfig('A', 'b')")[0] is True
    assert {r.short_name for r in spark.sql("SELECT * FROM RT_Drivers() ORDER BY 1").collect()} >= {"COG", "GTiff"} == {"COG", "GTiff"}
    assert drivers(spark).where("can_open").count() == 3


def test_georef():
    ref = Georef.parse(METADATA)
    assert ref.pixel(499980.0, 4800000.0) == (0, 0) and ref.pixel(499979.9, 4799994.9) == (-1, 1)
    turned = Georef((0.0, 0.0, 2.0, 0.0, 2.0, 0.0), 8, 8)
    assert turned.pixel(5.0, 9.0) == (4, 2)
    for wrong in ("x", "[]", "{}", '{"transform": [1]}', METADATA.replace('"blocksize_x": 128', '"blocksize_x": "a"')):
        with pytest.raises(RasterError):
            Georef.parse(wrong)
    with pytest.raises(RasterError):
        Georef((0.0, 0.0, 0.0, 0.0, 0.0, 0.0), 8, 8).pixel(1, 1) if False else Georef((0.0, 1.0, 1.0, 0.0, 1.0, 1.0), 8, 8).pixel(1, 1)
    fine = Grid(3, 3, 1, TYPE_CODES["FLOAT"], float("nan"), "", (1 / 3, 0.1, 0.0, 2.0, 0.0, -0.1), 3, 3)
    assert Georef.parse(fine.metadata()).transform[0] == 1 / 3


def test_streaming(spark, tmp_path):
    from tilewright.streaming import running_stats, stream_tiles

    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "state"))
    folder = tmp_path / "in"
    folder.mkdir()
    raster(folder / "a.tif", np.full((1, 20, 20), 3, "u1"))
    s = running_stats(stream_tiles(spark, str(folder), blocksize_x=10, blocksize_y=10), ["tile_x"])
    q = s.writeStream.format("memory").outputMode("complete").queryName("seen").start()
    try:
        q.processAllAvailable()
        raster(folder / "b.tif", np.full((1, 20, 20), 5, "u1"))
        q.processAllAvailable()
        rows = spark.sql("SELECT tile_x, sum(stats.valid_count) AS n, sum(stats.sum) AS total FROM seen GROUP BY tile_x ORDER BY 1").collect()
        assert [(r.tile_x, r.n, r.total) for r in rows] == [(0, 400, 1600.0), (1, 400, 1600.0)]
    finally:
        q.stop()


def test_statements(spark, overlay, tmp_path):
    path, cells = overlay
    assert run(spark, f"SELECT count(*) AS n FROM '{path}' AS t").first().n == read_tiles(spark, path).count()
    n = run(spark, f"SELECT count(*) AS n FROM RT_Read(['{path}', '{path}'], separate_bands := true, blocksize_x := 64, blocksize_y := 64) WHERE tile_x IN (1, 2) /* two */ -- columns").first().n
    assert n == 6
    assert run(spark, f"SELECT count(*) AS n, max(c.band_1) AS top FROM RT_ReadCells('{path}', warp_options := [], ignore_nodata := 0) c;").first().top == cells[0].max()
    out = tmp_path / "o.tif"
    copied = run(
        spark,
        f"""COPY (
            SELECT * FROM RT_Read('{path}', blocksize_x := 320, blocksize_y := 8)
        )
        TO '{out}'
        WITH (
            FORMAT RASTER, DRIVER 'COG', CREATION_OPTIONS ('COMPRESS=LZW'), RESAMPLING 'nearest', ENVELOPE [545539.750, 4724420.250, 545699.750, 4724510.250],
            SRS 'EPSG:25830', GEOMETRY_COLUMN 'geometry', DATABAND_COLUMNS ['databand_3', 'databand_2', 'databand_1']
        );""",
    )
    assert copied.first()[0] == 23 and run(spark, f"SELECT COUNT(id) FROM RT_Read('{out}')").first()[0] == 1
    assert (open_file(str(out)).read(0, 0, 0, 320, 180) == cells[2]).all()
    made = run(spark, "SELECT * FROM RT_Create('/vsimem/raster-sample.tiff', 'EPSG:25830', 499980.0, 4789760.0, 510220.0, 4800000.0, 2048, 2048, 1, 3 /*GDT_Int16*/, -9999.0, driver_name := 'Memory', blocksize_x := 512, blocksize_y := 512)")
    assert made.count() == 16 and Cube.load(bytes(made.first().databand_1)).values[0] == -9999
    with pytest.raises(ValueError):
        run(spark, "COPY (SELECT 1) TO 'x' WITH (FORMAT CSV)")
    assert run(spark, "SELECT [1, 2, 3][1] AS x, size(['a[', 'b']) AS n").first() == (2, 2)


def test_stream_windows_and_sink(spark, tmp_path):
    """Session windows, and files written from micro-batches."""
    from tilewright.streaming import running_stats, stream_tiles, write_stream

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for i, day in enumerate((0, 1, 9)):
        cells = np.full((1, 4, 4), i + 1, "f4")
        path = raster(folder / f"r{i}.tif", cells, nodata=-1.0, transform=(0.0, 1.0, 0.0, 4.0, 0.0, -1.0))
        os.utime(path, (1_600_000_000 + 86_400 * day,) * 2)
    t = stream_tiles(spark, str(folder), files_per_trigger=1, blocksize_x=4, blocksize_y=4)
    running_stats(t, ["tile_x"], gap="2 days", late="100 days").writeStream.option("checkpointLocation", str(tmp_path / "s")).outputMode("complete").format("memory").queryName("sessions").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.stats.valid_count, r.stats.sum) for r in spark.table("sessions").collect()) == [(16, 48.0), (32, 48.0)]
    write_stream(t, str(out), str(tmp_path / "w"), srs="EPSG:25830").trigger(availableNow=True).start().awaitTermination()
    files = sorted(out.glob("*.tif"))
    assert len(files) == 3 and sorted(float(open_file(str(f)).read(0, 0, 0, 4, 4).mean()) for f in files) == [1.0, 2.0, 3.0]


def test_box_join(spark):
    from tilewright.operators.spatial import box_join

    rng = np.random.default_rng(8)
    boxes = lambda n, most: [(i, *(float(v) for v in (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(rng.integers(-40, 40, n), rng.integers(-40, 40, n), rng.integers(0, most, n), rng.integers(0, most, n)))]
    left, right = boxes(60, 5) + [(100, None, 0.0, 1.0, 1.0), (101, -1000.0, -1000.0, 1000.0, 1000.0)], boxes(50, 30) + [(7, 3.0, 3.0, 3.0, 3.0)]
    names = lambda s: f"{s} int, {s}0 double, {s}1 double, {s}2 double, {s}3 double"
    columns = lambda s: [F.col(f"{s}{i}") for i in range(4)]
    a, b = spark.createDataFrame(left, names("l")), spark.createDataFrame(right, names("r"))
    want = sorted((p[0], q[0]) for p in left for q in right if p[1] is not None and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    for rows in (0, 1000):
        assert sorted(map(tuple, box_join(a, b, columns("l"), columns("r"), rows).select("l", "r").collect())) == want


def test_scans_prune_by_themselves(spark, overlay, tmp_path):
    """Columns that nobody asks for are not read, filters choose tiles before the bands are, broken bands do no harm then."""
    path, cells = overlay
    t = read_tiles(spark, path, blocksize_x=32, blocksize_y=32)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan(t.where("tile_x = 3 and bbox.ymax < 4724500").select("id", "cols", "metadata"))
    cut = plan(t.where("tile_x = 3").select("databand_2"))
    assert cut.index("ArrowEvalPython") < cut.index("Filter") and cut.count("run(") <= 3
    assert t.where("tile_x = 3").count() == 6 and t.limit(4).select("databand_1").count() == 4
    with pytest.raises(RasterError, match="open_options"):
        read_tiles(spark, path, open_options=["X=Y"])


def test_options_of_the_session(spark, overlay, caplog):
    path, _ = overlay
    assert run(spark, "SELECT RT_GdalConfig('GDAL_CACHEMAX', '3') AS a, RT_GdalConfig('OTHER', NULL) AS b").first() == (True, True)
    try:
        t = read_tiles(spark, path, blocksize_x=160, blocksize_y=90)
        assert t.select("databand_1").count() == 4 and spark.conf.get("spark.tilewright.GDAL_CACHEMAX") == "3"
        rt.rt_gdal_config(spark, "CPL_DEBUG", "ON")
        assert len(read_tiles(spark, path, blocksize_x=160, blocksize_y=90).where("id = 3").select("databand_2").collect()) == 1
        o = Options({"path": path, "blocksize_x": "160", "blocksize_y": "90", "CPL_DEBUG": "ON", "GDAL_CACHEMAX": "3"})
        assert len(Scan(o).cube(o, [3], (1,))) == 1 and o.cache_bytes == 3_000_000
        assert "tile 3: columns 160 and 160 more, rows 90 and 90 more" in caplog.text
    finally:
        for key in ("GDAL_CACHEMAX", "CPL_DEBUG"):
            rt.rt_gdal_config(spark, key, None)


def test_statistics_in_statements(spark, overlay):
    """What run() makes of RT_CubeStats_Agg is what the aggregate gives: groups, zones, empty tables."""
    path, cells = overlay
    rt.register_all(spark)
    read_tiles(spark, path, blocksize_x=64, blocksize_y=64).createOrReplaceTempView("tw_statistics")
    zone = "ST_MakeEnvelope(545550.0D, 4724430.0D, 545600.0D, 4724500.0D)"
    for q in ("SELECT tile_x, RT_CubeStats_Agg(databand_1, 0) AS s FROM tw_statistics GROUP BY tile_x", f"SELECT 1 AS tile_x, RT_CubeStats_Agg(databand_2, 0, tile_x, tile_y, metadata, {zone}) AS s FROM tw_statistics"):
        want, got = ({r.tile_x: r.s for r in df.collect()} for df in (spark.sql(q), run(spark, q)))
        assert want.keys() == got.keys() and all(got[k].asDict() == pytest.approx(want[k].asDict()) for k in want)
    none = run(spark, "SELECT RT_CubeStats_Agg(databand_1, 0) AS s FROM tw_statistics WHERE id < 0").collect()
    assert [set(r.s.asDict().values()) for r in none] == [{0}]


def test_remote_files(tmp_path, monkeypatch):
    """A file system of Arrow's under a scheme of its own: files are written, listed, moved, read and removed there."""
    import pyarrow.fs
    from pyspark.sql import Row
    from pyspark.sql import types as T

    from tilewright.geo.geometry import rectangle, to_wkb
    from tilewright.sources import files
    from tilewright.sources.writer import RasterWriter

    monkeypatch.setattr(files, "_remote", lambda path: (pyarrow.fs.SubTreeFileSystem(str(tmp_path), pyarrow.fs.LocalFileSystem()), path.split("://")[1]))
    schema = T.StructType([T.StructField(n, T.BinaryType()) for n in ("geometry", "databand_1")])
    cells = np.arange(16, dtype="<f4")
    row = Row("geometry", "databand_1")(to_wkb(rectangle(0.0, 0.0, 8.0, 8.0)), Cube.of(cells, 1, 4, 4, -1.0).dump())
    writer = RasterWriter({"path": "far://a/b/out.tif", "count_file": "far://a/b/n"}, schema, True)
    writer.commit([writer.write(iter([row])), writer.write(iter([]))])
    assert files.read_all("far://a/b/n") == b"1" and files.siblings("far://a/b/n") == ["out.tif"]
    assert (open_file("far://a/b/out.tif").read(0, 0, 0, 4, 4).ravel() == cells).all()
    files.move("far://a/b/out.tif", "far://a/b/c.tif")
    files.make_folder("far://a/d/e")
    files.move("far://a/b/c.tif", str(tmp_path / "here.tif"))
    assert not files.exists("far://a/b/c.tif") and files.exists(str(tmp_path / "here.tif")) and (tmp_path / "a" / "d" / "e").is_dir()
    assert files.siblings(str(tmp_path / "here.tif")) == []
    files.remove("far://a")
    files.remove("far://a")
    assert not (tmp_path / "a").exists()
