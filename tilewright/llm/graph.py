"""Distributed union-find: connected components by alternating large-star and small-star rounds.

No node's neighbourhood is gathered: each half round is one grouped minimum and one join, both of
which Spark can split or pre-aggregate, and each round is cut by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """u -> the least of u and its neighbours, over edges in both directions."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges a task of a round, where they are few: a small graph is not written as hundreds of files a round.
EDGES_A_TASK = 50_000


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(u, v) links of any comparable type -> (node, root): root is the least node of the component.

    Nodes without links do not appear. Raises if it has not converged after `rounds` rounds, which
    are logarithmic in the size of a component.
    """
    edges = scratch.write(edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc0")
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before = state(edges)
    if not before["n"]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for i in range(1, rounds + 1):
        edges = scratch.write(_small_star(_large_star(edges)).coalesce(1 + before["n"] // EDGES_A_TASK), f"cc{i}")
        now = state(edges)
        scratch.drop(f"cc{i - 1}")
        if now == before:
            star = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return star.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
