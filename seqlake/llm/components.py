"""Connected components over a distributed edge table by alternating large and small stars.

Every step is a grouped minimum and a join on node ids; no component is gathered in
one task. Each step's edges are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.session import discard, materialize

MAX_STEPS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    nb = edges.union(back) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = nb.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    j = nb.join(low, nb["u"] == low["k"])
    if large:
        out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node id reachable) for every node of ``links(a, b)`` with a link to another."""
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(MAX_STEPS):
        last, edges = edges, materialize(_star(_star(edges, True), False), "cc")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        discard(last)
    raise RuntimeError(f"no fixed point after {MAX_STEPS} steps")
