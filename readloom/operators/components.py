"""Connected components by star contraction: the number of rounds grows with the logarithm of the longest path, not with the path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the nodes of all edges, loops included; a component is named by its least node.

    A round hangs the larger neighbours of each node, then the smaller ones, on the least of them; it ends when nothing changes."""
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    nodes = ends.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    now = cut(ends.where("x != y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
    while True:
        both = now.select("hi", "lo").unionAll(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        root = both.groupBy("hi").agg(F.min("lo").alias("r")).select("hi", F.least("hi", "r").alias("r"))
        hung = both.join(root, "hi").where("lo > hi and lo != r").select(F.col("lo").alias("hi"), F.col("r").alias("lo")).distinct()
        least = hung.groupBy("hi").agg(F.min("lo").alias("r"))
        small = hung.join(least, "hi").where("lo != r").select(F.col("lo").alias("hi"), F.col("r").alias("lo")).unionAll(least.select("hi", F.col("r").alias("lo")))
        after = cut(small.distinct())
        settled = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty()
        now = after
        if settled:
            break
    return nodes.join(now.select(F.col("hi").alias("node"), F.col("lo").alias("_lo")), "node", "left").select("node", F.coalesce("_lo", "node").alias("component"))
