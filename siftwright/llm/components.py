"""Connected components by alternating large-star and small-star rounds; no step gathers a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v), v a neighbour of u.  Neighbours are hung under the smallest node that u knows."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    hung = pairs.join(low, "u")
    hung = hung.where("v > u") if large else hung
    out = hung.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b: any ordered type); comp is the component's smallest node.

    Self-loops and repeated edges are allowed; rows with a null end are ignored.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    nodes = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(cur)
    while seen[0]:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _star(both, True).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        cur = stored(_star(wide, False), "edges")
        if (now := mark(cur)) == seen:
            break
        seen = now
    return nodes.join(cur, nodes.node == cur.a, "left").select("node", F.coalesce("b", "node").alias("comp"))
