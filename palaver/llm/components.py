"""Connected components over an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join on the node. A node with very many edges is no hot key in that join: nodes with over a thousandth
of all edges, of which there are fewer than a thousand, are broadcast (``common.join_counted``). Each round is written to the shared checkpoint folder, so plans stay short and a lost
executor costs no more than a round. Nothing but a few numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialise


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, m) for edges(a, b), m the smallest neighbour of a; and (a, m, n), a row a node."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
    return join_counted(edges, least, ["a"], "n"), least


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _with_least(both)[0].withColumn("m", F.least("a", "m"))
    return near.filter((F.col("b") > F.col("a")) & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near, least = _with_least(down)
    moved = near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; root is the smallest node that can be reached."""
    state = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        count, check = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not count or (count, check) == mark:
            break
        mark = (count, check)
        state = materialise(_small_star(materialise(_large_star(state))))
    pairs = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(state.select("b", "b").distinct()) if count else pairs
