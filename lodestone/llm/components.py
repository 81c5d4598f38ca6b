"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, shuffled, stage


def _mark(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart; one row reaches the driver."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (large: those above it, else those below it, and itself) to the least of all."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node that has a link, and the least node that it reaches.

    links has the columns u and v; order, repeats and u = v are of no matter.  Each round pre-aggregates before it shuffles;
    a node with many links is a skewed join key, which AQE splits.  Rounds grow as the square of the logarithm of the
    nodes at most.  No links: no rows.
    """
    edges = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while mark != (now := _mark(edges)) and now[0]:
        mark = now
        before, edges = edges, stage(_star(_star(edges, large=True), large=False), "links")
        drop(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
