"""Statistics of cubes: per tile, restricted to a zone, and merged over tiles of a group.

Cells that are not valid (nodata, NaN, infinite) are counted as nodata. The standard deviation is the
population's. Partial states are merged by the formula for means and squared deviations: first inside each task,
before anything is shuffled, then between tasks, so that the shuffle carries one small state for each group and task
and a group's tiles never meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = T.StructType([T.StructField(n, t) for n, t in (("n", T.LongType()), ("nodata", T.LongType()), ("low", T.DoubleType()), ("high", T.DoubleType()), ("total", T.DoubleType()), ("mean", T.DoubleType()), ("m2", T.DoubleType()))])
STATS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("minimum", "maximum", "sum", "mean", "stddev")] + [T.StructField(n, T.LongType()) for n in ("valid_count", "nodata_count")])


def no_states(size: int) -> dict[str, np.ndarray]:
    return {f.name: np.zeros(size, np.int64 if f.dataType == T.LongType() else np.float64) for f in STATE.fields}


def partials(cells: np.ndarray, nodata: float, masks: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The states of many tiles, tiles x cells; with masks of the cells that masks hold."""
    valid = np.isfinite(cells) & (cells != nodata)
    size = np.full(len(cells), cells.shape[1])
    if masks is not None:
        valid, size = valid & masks, masks.sum(axis=1)
    n = valid.sum(axis=1)
    some = n > 0
    out = no_states(len(cells)) | {"n": n, "nodata": size - n}
    if some.any():
        kept = np.where(valid, cells, 0.0)
        out["total"] = kept.sum(axis=1)
        out["mean"] = out["total"] / np.maximum(n, 1)
        out["m2"] = np.where(valid, (kept - out["mean"][:, None]) ** 2, 0.0).sum(axis=1)
        out["low"] = np.where(some, np.where(valid, cells, np.inf).min(axis=1), 0.0)
        out["high"] = np.where(some, np.where(valid, cells, -np.inf).max(axis=1), 0.0)
    return out


def merged_groups(group: np.ndarray, groups: int, states: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The states of rows merged by their group's number, 0 to groups - 1."""
    out = no_states(groups)
    for name in ("n", "nodata", "total"):
        np.add.at(out[name], group, states[name])
    some = states["n"] > 0
    low, high = np.full(groups, np.inf), np.full(groups, -np.inf)
    np.minimum.at(low, group[some], states["low"][some])
    np.maximum.at(high, group[some], states["high"][some])
    filled = out["n"] > 0
    out["low"][filled], out["high"][filled] = low[filled], high[filled]
    weighted = np.zeros(groups)
    np.add.at(weighted, group, states["n"] * states["mean"])
    out["mean"] = np.divide(weighted, out["n"], out=np.zeros(groups), where=filled)
    np.add.at(out["m2"], group, states["m2"] + states["n"] * (states["mean"] - out["mean"][group]) ** 2)
    return out


def finished_many(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    deviation = np.sqrt(np.divide(s["m2"], s["n"], out=np.zeros(len(s["n"])), where=s["n"] > 0))
    return {"minimum": s["low"], "maximum": s["high"], "sum": s["total"], "mean": s["mean"], "stddev": deviation, "valid_count": s["n"], "nodata_count": s["nodata"]}


def partial(cells: np.ndarray, nodata: float) -> dict:
    """The state of some cells (doubles)."""
    return {k: v[0].item() for k, v in partials(cells.reshape(1, -1), nodata).items()}


def merged(a: dict, b: dict) -> dict:
    both = {k: np.array([a[k], b[k]]) for k in STATE.names}
    return {k: v[0].item() for k, v in merged_groups(np.zeros(2, np.int64), 1, both).items()}


def finished(s: dict) -> dict:
    return {k: v[0].item() for k, v in finished_many({k: np.array([v]) for k, v in s.items()}).items()}


def struct_of(values: dict[str, np.ndarray], null: np.ndarray, kind: T.StructType) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(values[n]) for n in kind.names], list(kind.names), mask=pa.array(null))


def _merge(a: Column, b: Column) -> Column:
    n, d = a["n"] + b["n"], b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"), (a["nodata"] + b["nodata"]).alias("nodata"), F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"), (a["total"] + b["total"]).alias("total"),
        (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"),
    )
    counted = lambda s: F.struct(*[(a["nodata"] + b["nodata"]).alias("nodata") if f == "nodata" else s[f].alias(f) for f in STATE.names])
    return F.when(a["n"] == 0, counted(b)).when(b["n"] == 0, counted(a)).otherwise(both).cast(STATE)


#: States that a task holds before it merges them and, if there are still more than half, passes them on.
HELD = 100_000


def _merge_in_task(keys: int):
    """Batches of (keys…, state) -> one row for each group of the task, if its groups are fewer than HELD / 2."""

    def combined(rows: pa.Table) -> pa.Table:
        names = rows.column_names[:keys]
        state = rows.column(keys).combine_chunks()
        states = {n: pc.struct_field(state, n).fill_null(0).to_numpy(zero_copy_only=False) for n in STATE.names}  # a null state: no cells
        if keys:
            numbered = rows.select(names).append_column("_i", pa.array(np.arange(len(rows)))).group_by(names, use_threads=False).aggregate([("_i", "list"), ("_i", "count")])
            count = numbered.column("_i_count").to_numpy()
            group = np.empty(len(rows), np.int64)
            group[numbered.column("_i_list").combine_chunks().flatten().to_numpy()] = np.repeat(np.arange(len(count)), count)
            heads = numbered.select(names)
        else:
            group, count, heads = np.zeros(len(rows), np.int64), [len(rows)], pa.table({})
        whole = struct_of(merged_groups(group, len(count), states), np.zeros(len(count), bool), STATE)
        return pa.Table.from_arrays([*heads.columns, whole], names=rows.column_names) if keys else pa.table([whole], names=rows.column_names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(combined(pa.Table.from_batches([batch])))
                size += len(held[-1])
            if size > HELD:
                held = [combined(pa.concat_tables(held))]
                size = len(held[0])
                if size > HELD // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from combined(pa.concat_tables(held)).to_batches()

    return run


def running(state: Column) -> Column:
    """Aggregate: the statistics of a group's states from sums alone, where a state must stay small, as in streams.

    The deviation comes from the sum of squares, which loses digits where the mean is large against it.
    """
    n, total = F.sum(state["n"]), F.sum(state["total"])
    filled = F.when(state["n"] > 0, state)
    squares = F.sum(state["m2"] + state["n"] * state["mean"] * state["mean"])
    mean = F.when(n > 0, total / n).otherwise(F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    deviation = F.when(n > 0, F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))).otherwise(F.lit(0.0))
    return F.struct(zero(F.min(filled["low"])).alias("minimum"), zero(F.max(filled["high"])).alias("maximum"), zero(total).alias("sum"), zero(mean).alias("mean"), zero(deviation).alias("stddev"), F.coalesce(n, F.lit(0).cast("long")).alias("valid_count"), F.coalesce(F.sum(state["nodata"]), F.lit(0).cast("long")).alias("nodata_count"))


_ZERO = {"n": 0, "nodata": 0, "low": 0.0, "high": 0.0, "total": 0.0, "mean": 0.0, "m2": 0.0}


def _fold(states: Column) -> Column:
    zero = F.struct(*[F.lit(v).cast(STATE[k].dataType).alias(k) for k, v in _ZERO.items()]).cast(STATE)
    return F.aggregate(states, zero, _merge)


def stats_of(state: Column) -> Column:
    """A state as minimum, maximum, sum, mean, stddev, valid_count, nodata_count."""
    deviation = F.when(state["n"] == 0, F.lit(0.0)).otherwise(F.sqrt(state["m2"] / F.greatest(state["n"], F.lit(1))))
    return F.struct(state["low"].alias("minimum"), state["high"].alias("maximum"), state["total"].alias("sum"), state["mean"].alias("mean"), deviation.alias("stddev"), state["n"].alias("valid_count"), state["nodata"].alias("nodata_count"))


def cube_stats_agg(df: DataFrame, by: list, cube: Column | str, band: Column | int = 0, *zone: Column | str, name: str = "stats") -> DataFrame:
    """RT_CubeStats_Agg: one row a group with the statistics of all its tiles.

    zone: tile_x, tile_y, metadata, geometry; then only cells that meet the geometry count. Rows with a null
    argument are left out; a group without others (and an empty table, if by is empty) gives zeros.
    """
    from tilewright.functions import cube_state

    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names)], cube_state(cube, band, *zone).alias("_s"))
    if not any(isinstance(rows.schema[n].dataType, (T.ArrayType, T.MapType, T.StructType)) for n in names):
        rows = rows.mapInArrow(_merge_in_task(len(names)), rows.schema)
    out = rows.groupBy(*names).agg(_fold(F.filter(F.collect_list("_s"), lambda s: s.isNotNull())).alias("_s"))
    titles = [k if isinstance(k, str) else df.select(k).columns[0] for k in by]
    return out.select(*[F.col(n).alias(t) for n, t in zip(names, titles)], stats_of(F.col("_s")).alias(name))
