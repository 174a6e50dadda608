"""Rasters made of the driver's tables: each 64-value vector is an 8 x 8 tile of a grid 25 tiles wide."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.cube import TYPE_CODES, RasterError
from tilewright.functions import rt_array2cube, st_make_envelope
from tilewright.sources.files import local
from tilewright.sources.grid import Grid
from tilewright.sources.writer import write_raster

ACROSS, SIDE, NODATA, FAINT = 25, 8, -9999.0, 0.02
X0, Y0, CELL = 1000.0, 50000.0, 2.0
GRID = Grid(ACROSS * SIDE, 100_000 * SIDE, 1, TYPE_CODES["FLOAT"], NODATA, "EPSG:25830", (X0, CELL, 0.0, Y0, 0.0, -CELL), SIDE, SIDE)


def _faint(values: Column) -> Column:
    """Cells near zero become nodata."""
    return F.transform(values, lambda v: F.when(F.abs(v.cast("double")) < FAINT, F.lit(NODATA).cast("float")).otherwise(v))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, tile_x, tile_y, metadata, geometry, a (the vector as a cube), b (the same in reverse)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    cube = lambda v: rt_array2cube(v, F.lit("RAW"), F.lit(1), F.lit(SIDE), F.lit(SIDE), F.lit(NODATA))
    rows = rows.withColumns({"tile_x": (F.col("vec_id") % ACROSS).cast("int"), "tile_y": F.floor(F.col("vec_id") / ACROSS).cast("int")})
    x, y, step = F.lit(X0) + F.col("tile_x") * (SIDE * CELL), F.lit(Y0) - F.col("tile_y") * (SIDE * CELL), SIDE * CELL
    values = _faint(F.col("embedding"))
    return rows.select("vec_id", "label", "tile_x", "tile_y", F.lit(GRID.metadata()).alias("metadata"), st_make_envelope(x, y - step, x + step, y).alias("geometry"), cube(values).alias("a"), cube(F.reverse(values)).alias("b"))


def folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a local one where that is unset in a local session."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RasterError("spark.checkpoint.dir must name a folder that all machines mount")
        return tempfile.mkdtemp(prefix="tilewright-")
    if local(at) is None:
        raise RasterError(f"Rasters are written to mounted paths: {at}")
    made = f"{local(at)}/raster-{uuid.uuid4().hex}"
    os.makedirs(made)
    return made


def file(spark: SparkSession, sf_dir: str, **options) -> str:
    """The tiles' raster as a file, in a folder of its own."""
    path = f"{folder(spark)}/raster.{'png' if options.get('driver') == 'PNG' else 'tif'}"
    write_raster(tiles(spark, sf_dir).select("geometry", "a", "b"), path, srs="EPSG:25830", databand_columns=["a", "b"], **options)
    return path
