"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). Large: of a node's neighbours those above it move to the least of all; small: those below it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    own = both if large else both.filter("v < u")
    least = materialize(own.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    moved = own.filter("v > u") if large else own
    out = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """edges (u long, v long) -> node, component (its least node), for nodes with an edge. Each step is written as a table."""
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0] and most:
        now = materialize(_star(_star(now, True), False), "edges")
        if seen == (seen := mark(now)):
            break
        most -= 1
    if seen[0] and not most:
        raise RuntimeError("the components haven't settled")
    # now each node points to the least of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
