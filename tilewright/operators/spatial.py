"""Joins of rows whose boxes share a point.

A side of few rows is broadcast behind a count. Beyond it both sides are shuffled on cells of a grid of several
levels: a box belongs to the level whose cells are at least as large as it is, so it meets four cells of that or any
coarser level at most, however large it is. A pair meets at the coarser one of its two levels, and counts in one of the
cells that both boxes meet, that of the lower left corner of what they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 10_000
#: The finest level's cells are 2 ** FINEST wide.
FINEST = -30
BOX = ("xmin", "ymin", "xmax", "ymax")


def _meet(a: list[Column], b: list[Column]) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def _cells(df: DataFrame, box: list[Column], levels: list[int], side: str) -> DataFrame:
    """df's columns as a struct, its box and its cells of its own and each coarser one of the levels."""
    own = F.greatest(F.ceil(F.log2(F.greatest(box[2] - box[0], box[3] - box[1], F.lit(2.0**FINEST)))), F.lit(FINEST)).cast("int")
    rows = df.select(F.struct("*").alias(side), *[c.alias(f"{side}_{n}") for n, c in zip(BOX, box)], own.alias(f"{side}_level"))
    rows = rows.withColumn("level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col(f"{side}_level"))))
    for axis in ("x", "y"):
        cell = lambda end: F.floor(F.col(f"{side}_{axis}{end}") / F.pow(F.lit(2.0), F.col("level")))  # noqa: B023, E731
        rows = rows.withColumn(f"cell_{axis}", F.explode(F.sequence(cell("min"), cell("max"))))
    return rows


def _levels(df: DataFrame, box: list[Column]) -> set[int]:
    own = F.greatest(F.ceil(F.log2(F.greatest(box[2] - box[0], box[3] - box[1], F.lit(2.0**FINEST)))), F.lit(FINEST)).cast("int")
    return {r[0] for r in df.select(own.alias("l")).where("l is not null").distinct().collect()}  # an exponent of a double each: some hundreds at most


def box_join(left: DataFrame, right: DataFrame, left_box: list[Column], right_box: list[Column], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pairs of rows whose closed boxes (xmin, ymin, xmax, ymax) share a point; a box with a null meets none.

    The columns of both sides, which must have different names.
    """
    if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return left.join(F.broadcast(right), _meet(left_box, right_box))
    levels = sorted(_levels(left, left_box) | _levels(right, right_box))
    whole = lambda df, box: df.where(~F.greatest(*[c.isNull() for c in box]))
    pairs = _cells(whole(left, left_box), left_box, levels, "l").join(_cells(whole(right, right_box), right_box, levels, "r"), ["level", "cell_x", "cell_y"])
    corner = lambda axis: F.floor(F.greatest(f"l_{axis}min", f"r_{axis}min") / F.pow(F.lit(2.0), F.col("level")))
    boxes = [[F.col(f"{side}_{n}") for n in BOX] for side in ("l", "r")]
    once = (F.col("level") == F.greatest("l_level", "r_level")) & (corner("x") == F.col("cell_x")) & (corner("y") == F.col("cell_y"))
    return pairs.where(once & _meet(*boxes)).select("l.*", "r.*")
