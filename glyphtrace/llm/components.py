"""Connected components of a table of edges, by alternating large-star and small-star steps (Kiveris et al., 2014).

Cases: loops, repeated edges and edges given both ways count once; an edge with a null end is none; no edges give no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    """u and the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


#: Edges that a task of a round takes.
TASK_EDGES = 100_000


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, label (the least node of its component) of every node of the edges (u, v).

    Each round is two joins on a node, whose hot side Spark splits; edges are written after each step, so that a
    lost executor costs a task. Raises if it doesn't end within max_rounds (twice the square of the logarithm is
    expected at most).
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # neither step makes more edges than it gets; tasks are as many as these need
    tasks = max(4, -(-e.count() // TASK_EDGES))
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.coalesce(tasks))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        e = cut(small.where("u <> v").distinct().coalesce(tasks))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        state = now
    raise RuntimeError(f"components: no end after {max_rounds} rounds")
