"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation and a join on the edges, so no component is ever gathered in one place; the number of
rounds grows with the logarithm of the longest path. Each round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    e = _both(edges)
    low = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return e.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of longs -> (id, root) with the smallest id of its component, for every id that has an edge.

    Self-edges and repeated edges are fine (an id that has only self-edges is left out); no edges give no rows.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    mark = None
    while True:
        now = cut(_small_star(_large_star(now)).filter("u != v").distinct())
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark:
            break
        mark = new
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return cut(roots.union(roots.select(F.col("root").alias("id"), "root").distinct()))
