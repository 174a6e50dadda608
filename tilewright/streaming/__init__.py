"""Rasters that arrive in a folder as an unbounded tile table: running statistics, changes by place, and a sink of files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tilewright.operators.stats import running
from tilewright.sources.reader import TILE_FIELDS, Options, TileReader, Tiles

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("arrived", T.TimestampType()), *[T.StructField(n, t) for n, t in TILE_FIELDS], T.StructField("datacube", T.BinaryType())])


def stream_tiles(spark: SparkSession, folder: str, pattern: str = "*.tif", files_per_trigger: int | None = None, **options) -> DataFrame:
    """Tiles (one datacube column) of the files that appear in a folder, each file once; arrived is its time of change."""
    source = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    files = source.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "modificationTime")

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(SCHEMA)
        inner = T.StructType(SCHEMA.fields[2:])
        for batch in batches:
            for path, arrived in zip(batch.column(0).to_pylist(), batch.column(1)):
                given = {**{k: str(v) for k, v in options.items()}, "path": path, "datacube": "true"}
                grid = Options(given).grid
                for part in TileReader(given, inner).read(Tiles((0, grid.tiles_x * grid.tiles_y - 1))):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([arrived.as_py()] * n, batch.column(1).type), *part.columns], names=schema.names)

    return files.mapInArrow(read, SCHEMA)


def running_stats(tiles: DataFrame, by: list[str], cube: Column | str = "datacube", band: int = 0, window: str = "1 hour", late: str = "1 hour", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Statistics of the tiles that arrive in each time window, per group; windows close when the watermark passes.

    Windows of the length `window` stand side by side, or start every `slide`; with gap, a window lasts as long as a
    group's tiles arrive within it of one another. What a window keeps is a few sums, however many tiles arrive.
    """
    from tilewright.functions import cube_state

    rows = tiles.withWatermark("arrived", late).select("arrived", *by, cube_state(cube, band).alias("s"))
    span = F.session_window("arrived", gap) if gap else F.window("arrived", window, slide) if slide else F.window("arrived", window)
    return rows.groupBy(span.alias("window"), *by).agg(running(F.col("s")).alias("stats"))


CHANGES = "place string, arrivals long, before double, mean double"


def mean_changes(tiles: DataFrame, place: Column | str, cube: Column | str = "datacube", band: int = 0, forget: str = "30 days") -> DataFrame:
    """Stateful: for each arrival at a place the mean of its valid cells and that of the arrival before it, CHANGES.

    place: text that names where a tile lies. What is kept of a place is two numbers, until nothing came for `forget`
    of event time; arrivals of one micro-batch count in order of time. A tile without a valid cell has a null mean and
    leaves the one before it in place.
    """
    from tilewright.functions import rt_cube_stats

    s = rt_cube_stats(cube, F.lit(band))
    rows = tiles.withWatermark("arrived", forget).select(F.col(place).alias("place") if isinstance(place, str) else place.alias("place"), "arrived", F.when(s["valid_count"] > 0, s["mean"]).alias("mean"))

    def step(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        arrivals, before = state.get if state.exists else (0, None)
        out, last = [], 0
        for r in pd.concat(list(batches)).sort_values("arrived", kind="stable").itertuples():
            mean = None if pd.isna(r.mean) else float(r.mean)
            arrivals += 1
            out.append((key[0], arrivals, before, mean))
            before = before if mean is None else mean
            last = int(r.arrived.timestamp() * 1000)
        state.update((arrivals, before))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["place", "arrivals", "before", "mean"]).astype({"before": "float64", "mean": "float64"})

    return rows.groupBy("place").applyInPandasWithState(step, CHANGES, "arrivals long, before double", "append", "EventTimeTimeout")


def write_stream(tiles: DataFrame, folder: str, checkpoint: str, **options) -> DataStreamWriter:
    """A sink of raster files: the tiles of each micro-batch become a file of its number under folder, and a repeated batch replaces its own."""
    from tilewright.sources.writer import write_raster

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_raster(batch, f"{folder}/batch-{number:08d}.tif", **options)

    return tiles.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
