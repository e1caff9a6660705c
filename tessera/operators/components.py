"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import dropped, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's links moved to the smallest node it knows; minima are pre-aggregated, neighbours are never gathered."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least, "u")
    moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node that each node of `edges` (u, v) is linked to.

    Self-links and repeated links count for nothing beyond naming their node; links with a missing end are left out. The number of
    rounds grows with the logarithm of the number of nodes; each is staged, and goes on until nothing changes.
    """
    clean = edges.filter("u is not null and v is not null")
    nodes = clean.select("u").union(clean.select("v")).distinct().select(F.col("u").alias("node"))
    cur, seen = staged(clean.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"), None
    while True:  # the sum of the smaller ends falls with every round that changes anything, so there is an end
        new = staged(_star(_star(cur, True), False), "cc")
        dropped(cur)
        cur, now = new, new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    return nodes.join(cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
