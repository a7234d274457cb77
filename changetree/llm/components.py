"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, persisted


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node's neighbours (the larger ones, or the smaller ones and itself) get an edge
    to the smallest node around it."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(turned) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = persisted(around.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")))
    joined = around.join(least, "u")
    moved = joined.where("v > u") if large else joined.where("v <> m").unionByName(least.selectExpr("u", "u AS v", "m"))
    out = persisted(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
    dropped(least, edges)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of the edges (u, v): the smallest node of its component. Large-star
    and small-star steps alternate until every edge ends at its component's smallest node; nodes of
    many edges are pre-aggregated, and only a count and a checksum come to the driver."""
    edges = persisted(edges.where("u <> v").distinct())
    seen = None
    while True:
        edges = _star(_star(edges, True), False)
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == seen or not now[0]:
            break
        seen = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
