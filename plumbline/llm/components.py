"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage


def _hooked(edges: DataFrame) -> DataFrame:
    """Each edge (u, v), u > v, with ``low``: the smallest of u and all smaller neighbours of u."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(low, "u")


def _downward(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return turned.where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node of its component.

    Each round hangs all larger neighbours of a node below its smallest neighbour and
    then a node's smaller neighbours below the smallest of them, until every edge
    leads to a root. Rounds grow with the logarithm of a component's width. Loops and
    repeated edges are ignored; nodes must not be null. A node with many neighbours
    is a hot key on one side of a join alone.
    """
    stars = cut_lineage(_downward(edges))
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        hooked = _hooked(_downward(large))
        small = hooked.select("u", F.col("low").alias("v")).unionByName(hooked.select(F.col("v").alias("u"), F.col("low").alias("v")))
        stars = cut_lineage(_downward(small))
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = stars.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
