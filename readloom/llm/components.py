"""Connected components by alternating large-star and small-star steps, wholly in DataFrames.

Each step joins edges with the smallest neighbour of a node. A hot node (the centre of a star) is split by
Spark's skew join, the minima are partially aggregated, and every round is cut by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a non-loop edge; component is the smallest node reachable. Rows with a null end are ignored."""

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        table = materialize(df, label)
        state = table.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head()
        return table, tuple(state)

    start = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct()
    now, state = written(start)
    for _ in range(most_rounds if state[0] else 0):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u and v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(smallest.hint("merge"), "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(smallest.select("hi", F.col("m").alias("lo"))).distinct()
        after, new_state = written(small)
        drop_tables(now)
        now, state, was = after, new_state, state
        if state == was:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    lows = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(lows)
