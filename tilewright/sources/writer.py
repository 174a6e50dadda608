"""Writing tile tables to raster files: tasks spool tiles next to the target, the driver assembles block by block.

    df.write.format("raster").mode("overwrite").option("driver", "GTiff").option("srs", "EPSG:25830").save("/data/out.tif")

Options: driver (GTiff, COG, PNG), creation_options (a JSON list of KEY=VALUE: COMPRESS, BLOCKSIZE, WORLDFILE),
resampling (nearest), envelope (a JSON list xmin, ymin, xmax, ymax; ignored without width or height),
compute_valid_envelope (beats envelope), srs, geometry_column, databand_columns (a JSON list; default: all
columns that RasterSource names databand_N or datacube). The target is a path that all machines mount, or one of a file
system that Arrow knows; then the tiles are spooled beside it too, and the file is assembled on the driver's disk and
copied.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from tilewright.cube import DTYPES, NODATA_UNDEFINED, Cube, RasterError, is_nodata
from tilewright.geo.crs import normal
from tilewright.geo.geometry import envelope, from_wkb
from tilewright.sources.dataset import DRIVERS
from tilewright.sources.files import exists, local, move, open_output, open_stream, read_all, read_range, remove
from tilewright.sources.png import world_file, write_png
from tilewright.sources.tiff import TiffWriter

_KNOWN = {"path", "driver", "creation_options", "resampling", "envelope", "compute_valid_envelope", "srs", "geometry_column", "databand_columns", "mode", "count_file"}


@dataclass
class Spooled(WriterCommitMessage):
    file: str
    rows: int
    tiles: list  # (offset, size, box, cols, rows)
    head: tuple | None  # data type, nodata, bands


class RasterWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        options = {k.lower(): v for k, v in options.items()}
        if unknown := set(options) - _KNOWN:
            raise RasterError(f"Unknown option: {', '.join(sorted(unknown))}")
        self.path = options.get("path")
        if not self.path:
            raise RasterError("A path is needed")
        self.target = self.path if local(self.path) is None else os.path.abspath(local(self.path))
        self.driver = options.get("driver", "GTiff")
        found = {d.lower(): d for d in DRIVERS}.get(self.driver.lower())
        if found is None or not (DRIVERS[found][3] or DRIVERS[found][4]) or found == "Memory":
            raise RasterError(f"Unknown driver: {self.driver}")
        self.driver = found
        listed = lambda name: json.loads(options[name]) if options.get(name) else []
        self.creation = dict(o.upper().split("=", 1) if "=" in o else (o.upper(), "YES") for o in listed("creation_options"))
        if options.get("resampling", "nearest").lower() not in ("nearest", "near"):
            raise RasterError(f"Unsupported resampling: {options['resampling']}")
        self.envelope = [float(v) for v in listed("envelope")]
        if self.envelope and len(self.envelope) != 4:
            raise RasterError("The envelope needs 4 numbers")
        self.valid_envelope = options.get("compute_valid_envelope", "false").lower() == "true"
        self.srs = options.get("srs", "")
        names = schema.fieldNames()
        self.geometry = options.get("geometry_column", "geometry")
        self.columns = listed("databand_columns") or [n for n in names if n == "datacube" or n.startswith("databand_")]
        for n in (self.geometry, *self.columns):
            if n not in names:
                raise RasterError(f"Column not found: {n}")
            if not isinstance(schema[n].dataType, T.BinaryType):
                raise RasterError(f"Column {n} must be of type BINARY")
        if not self.columns:
            raise RasterError("No databand columns were found")
        if exists(self.target) and not overwrite:
            raise RasterError(f"The file exists: {self.path}")
        self.spool = f"{self.target}.spool-{uuid.uuid4().hex}"
        self.count_file = options.get("count_file")

    def write(self, iterator) -> Spooled:
        file, tiles, head, n = f"{self.spool}/{uuid.uuid4().hex}", [], None, 0
        with open_stream(file) as out:
            for row in iterator:
                n += 1
                shape, blobs = row[self.geometry], [row[c] for c in self.columns]
                box = envelope(from_wkb(bytes(shape))) if shape is not None else None
                if box is None or any(b is None for b in blobs):
                    continue
                cubes = [Cube.load(bytes(b)) for b in blobs]
                first = cubes[0].head
                if any((c.head.data_type, c.head.cols, c.head.rows) != (first.data_type, first.cols, first.rows) for c in cubes):
                    raise RasterError("All databands must have the same type and size")
                if not first.cells:
                    continue
                kind = (first.data_type, first.no_data, sum(c.head.bands for c in cubes))
                if head is not None and (kind[0], kind[2]) != (head[0], head[2]):
                    raise RasterError("All tiles must have the same type and number of bands")
                head = head or kind
                cells = np.concatenate([c.values.reshape(c.head.bands, first.rows, first.cols) for c in cubes])
                valid = None
                if self.valid_envelope:
                    keep = ~is_nodata(cells.astype(np.float64), first.no_data).all(axis=0)
                    if keep.any():
                        r, c = np.flatnonzero(keep.any(axis=1)), np.flatnonzero(keep.any(axis=0))
                        sx, sy = (box[2] - box[0]) / first.cols, (box[3] - box[1]) / first.rows
                        valid = (box[0] + c[0] * sx, box[3] - (r[-1] + 1) * sy, box[0] + (c[-1] + 1) * sx, box[3] - r[0] * sy)
                at = out.tell()
                out.write(cells.tobytes())
                tiles.append((at, cells.nbytes, box, first.cols, first.rows, valid))
        return Spooled(file, n, tiles, head)

    def abort(self, messages) -> None:
        remove(self.spool)

    def commit(self, messages) -> None:
        try:
            parts = [m for m in messages if m is not None and m.tiles]
            if parts:
                self._assemble(parts)
            if self.count_file:  # of the tasks whose output counts, however often one was tried
                with open_stream(self.count_file) as f:
                    f.write(str(sum(m.rows for m in messages if m is not None)).encode())
        finally:
            remove(self.spool)

    def _assemble(self, parts: list[Spooled]) -> None:
        heads = {(m.head[0], m.head[2]) for m in parts}
        if len(heads) > 1:
            raise RasterError("All tiles must have the same type and number of bands")
        data_type, nodata, bands = parts[0].head
        tiles = [(m.file, *t) for m in parts for t in m.tiles]
        boxes = np.array([t[3] for t in tiles])
        sx, sy = (boxes[0, 2] - boxes[0, 0]) / tiles[0][4], (boxes[0, 3] - boxes[0, 1]) / tiles[0][5]
        x0, y0, x1, y1 = boxes[:, 0].min(), boxes[:, 1].min(), boxes[:, 2].max(), boxes[:, 3].max()
        if self.valid_envelope:
            valid = np.array([t[6] for t in tiles if t[6] is not None])
            if len(valid):
                x0, y0, x1, y1 = valid[:, 0].min(), valid[:, 1].min(), valid[:, 2].max(), valid[:, 3].max()
        elif self.envelope and self.envelope[2] > self.envelope[0] and self.envelope[3] > self.envelope[1]:
            x0, y0, x1, y1 = self.envelope
        width, height = max(1, round((x1 - x0) / sx)), max(1, round((y1 - y0) / sy))
        transform = (float(x0), float(sx), 0.0, float(y1), 0.0, float(-sy))
        dtype, fill = DTYPES[data_type], 0 if nodata == NODATA_UNDEFINED else nodata
        # the tiles' places in the target, in cells
        places = np.rint(np.stack([(boxes[:, 0] - x0) / sx, (y1 - boxes[:, 3]) / sy, (boxes[:, 2] - x0) / sx, (y1 - boxes[:, 1]) / sy], axis=1)).astype(int)
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def cells(i: int) -> np.ndarray:
            if i not in held:
                file, at, size, _, cols, rows, _ = tiles[i]
                held[i] = np.frombuffer(read_range(file, at, size), dtype).reshape(bands, rows, cols)
                if len(held) > 64:
                    held.popitem(last=False)
            return held[i]

        block = height if self.driver == "PNG" else int(self.creation.get("BLOCKSIZE", self.creation.get("BLOCKXSIZE", 512 if self.driver == "COG" else 256)))
        # the tiles that meet each row of blocks, so that a block is held against these alone
        by_row: dict[int, list[int]] = {}
        for i, (low, high) in enumerate(zip(np.maximum(places[:, 1], 0) // block, (np.minimum(places[:, 3], height) - 1) // block)):
            for ty in range(low, high + 1):
                by_row.setdefault(ty, []).append(i)
        rows_of = {ty: np.array(found) for ty, found in by_row.items()}

        def window(x: int, y: int, w: int, h: int) -> np.ndarray:
            near = rows_of.get(y // block, np.zeros(0, int))
            p = places[near]
            out = np.full((bands, h, w), fill).astype(dtype)
            for i in near[(p[:, 0] < x + w) & (p[:, 2] > x) & (p[:, 1] < y + h) & (p[:, 3] > y)]:
                px0, py0, px1, py1 = places[i]
                cx0, cx1, cy0, cy1 = max(x, px0), min(x + w, px1), max(y, py0), min(y + h, py1)
                tile = cells(int(i))
                c = np.clip(((np.arange(cx0, cx1) + 0.5 - px0) * tile.shape[2] / (px1 - px0)).astype(int), 0, tile.shape[2] - 1)
                r = np.clip(((np.arange(cy0, cy1) + 0.5 - py0) * tile.shape[1] / (py1 - py0)).astype(int), 0, tile.shape[1] - 1)
                part = out[:, cy0 - y : cy1 - y, cx0 - x : cx1 - x]
                new = tile[:, r[:, None], c]
                keep = np.ones(new.shape, bool) if nodata == NODATA_UNDEFINED else ~is_nodata(new.astype(np.float64), nodata)
                part[keep] = new[keep]
            return out

        partial = f"{tempfile.mkdtemp()}/part" if local(self.target) is None else f"{self.target}.part-{uuid.uuid4().hex}"
        crs = normal(self.srs)
        if self.driver == "PNG":
            with open_output(partial) as f:
                write_png(f, np.moveaxis(window(0, 0, width, height), 0, 2))
            if self.creation.get("WORLDFILE") == "YES":
                with open_stream(world_file(self.target)) as f:
                    f.write("".join(f"{v!r}\n" for v in (transform[1], 0.0, 0.0, transform[5], transform[0] + transform[1] / 2, transform[3] + transform[5] / 2)).encode())
        else:
            scheme = self.creation.get("COMPRESS", "LZW" if self.driver == "COG" else "NONE")
            with open_output(partial) as f:
                out = TiffWriter(f, width, height, bands, dtype, nodata, crs, transform, scheme, block)
                for ty in range(out.down):
                    for tx in range(out.across):
                        w, h = min(block, width - tx * block), min(block, height - ty * block)
                        part = np.full((bands, block, block), fill).astype(dtype)
                        part[:, :h, :w] = window(tx * block, ty * block, w, h)
                        for b in range(bands):
                            out.write(b, tx, ty, part[b])
                out.close()
        move(partial, self.target)
        if local(self.target) is None:
            remove(os.path.dirname(partial))


def write_raster(df, path: str, **options) -> int:
    """Writes a tile table; returns the number of its rows. Lists among the options are passed on as JSON."""
    from tilewright.sources.reader import register

    spark = df.sparkSession
    register(spark)
    plain = {k: json.dumps(v) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    counted = f"{path if local(path) is None else os.path.abspath(local(path))}.count-{uuid.uuid4().hex}"
    try:
        df.write.format("raster").mode("overwrite").options(**plain, count_file=counted).save(path)
        return int(read_all(counted))
    finally:
        remove(counted)
