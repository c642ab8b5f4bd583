"""Connected components by alternating large-star and small-star steps; the driver only sees counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v), u > v: each node links its larger (or smaller) neighbours to its least one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        # a node without smaller neighbours is the least of its own neighbourhood
        linked = both.where("v > u").join(least, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        return linked.unionByName(own).where("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); the component is its least node."""
    now = scratch.table(f"{name}-0", edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    step, before = 0, None
    while not now.isEmpty():
        step += 1
        now = scratch.table(f"{name}-{step}", _stars(_stars(now, True), False))
        # done when each node has one neighbour and none is both a leaf and a centre
        state = tuple(now.agg(F.count(F.lit(1)), F.countDistinct("u"), F.bit_xor(F.xxhash64("u", "v"))).first())
        scratch.drop(f"{name}-{step - 1}")
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
