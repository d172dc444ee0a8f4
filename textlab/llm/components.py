"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.llm.common import written


def _towards_min(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: every neighbour of a node (only the larger ones, or only the smaller ones and
    the node itself) is linked to the smallest of its neighbours. A hub's minimum is combined before
    the shuffle, and its edges meet that minimum in a join, whose large partitions can be split."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    j = near.join(least, near["u"] == least["_u"]).drop("_u")
    if larger:
        out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(j.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v) that can reach a smaller one,
    component being the smallest reachable. Alternates links to the smallest among the larger and the smaller neighbours until
    every tree is a star; the number of rounds grows with the logarithm of a component's extent.
    Nulls and loops are no edges; without edges there are no rows."""
    e = edges.filter("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = written(e, "edges"), None
    while True:
        e = written(_towards_min(_towards_min(e, larger=True), larger=False), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
