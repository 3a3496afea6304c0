"""Connected components of a table of links: least neighbours, and links contracted to what they join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): for each node with a link the smallest node reachable. Links are (a, b).

    Each turn gives every node its least neighbour's least neighbour (or itself, if less), puts the
    new names in the place of both ends of the links and drops the links that became loops or equal
    ones, so a turn's tables are bounded by the components that are left, not by the links. Minima
    are formed before the shuffle, so a node with very many links is no hot key, and joins with its
    links can be split.
    """
    left = scratch.write(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "left")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = scratch.write(nodes.withColumn("label", F.col("node")), "labels")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = scratch.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "hook")
        jump = hook.join(hook.select(F.col("a").alias("up"), F.col("up").alias("top")), "up").select("a", "top")
        up = scratch.write(jump, "up")
        ends = left.join(up.select("a", F.col("top").alias("x")), "a").join(up.select(F.col("a").alias("b"), F.col("top").alias("y")), "b")
        fewer = scratch.write(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "left")
        named = labels.join(up.select(F.col("a").alias("label"), "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        renamed = scratch.write(named, "labels")
        for done in (left, hook, up, labels):
            scratch.drop(done)
        left, labels = fewer, renamed
    return labels
