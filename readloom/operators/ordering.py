"""Orders over whole tables without a task that holds them: sweeps in two levels, dense numbers and ranks by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .lineage import cut

#: Bases of a level of the sweep: a task orders what starts in one such stretch, a window over stretches carries the rest.
STRETCH = 1 << 20


def numbered(df: DataFrame, columns: list[str], name: str, first: int = 1) -> DataFrame:
    """Rows numbered in the order of the columns. Ranges are sorted apart; only the sizes of the ranges are ordered in one place, and
    they are as many as there are partitions. The sorted rows are checkpointed, as sampled ranges need not be the same twice."""
    place = F.monotonically_increasing_id()
    rows = cut(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_numbered_at", place))
    rows = rows.withColumn("_numbered_range", F.shiftright("_numbered_at", 33))
    sizes = rows.groupBy("_numbered_range").agg(F.count("*").alias("_n"), F.min("_numbered_at").alias("_numbered_least"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_numbered_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_numbered_range", "_numbered_least", before.alias("_numbered_before"))
    return rows.join(F.broadcast(starts), "_numbered_range").withColumn(name, F.col("_numbered_before") + F.col("_numbered_at") - F.col("_numbered_least") + first).drop("_numbered_range", "_numbered_at", "_numbered_least", "_numbered_before")


def running_before(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of `value` over the rows before, in the order of a column whose values differ. Without `by` ranges of the table are summed
    first; within `by` a window does."""
    if by:
        total = F.sum(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
        return df.withColumn(name, F.coalesce(total, F.lit(0)))
    rows = cut(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    inner = F.coalesce(F.sum(value).over(W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("_range").agg(F.sum(value).alias("_sum"))
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.withColumn("_inner", inner).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_inner")).drop("_range", "_inner", "_start")


def sweep(df: DataFrame, by: list[str], s: str, e: str, gap: int, name: str, stretch: int = STRETCH) -> DataFrame:
    """Numbers groups of intervals that overlap, or lie within `gap`, directly or through others, from 1 within `by`.

    Intervals are dealt by the stretch in which they start. The largest end so far comes from inside the stretch and from one value
    per earlier stretch; likewise the number of groups begun so far."""
    rows = df.withColumn("_stretch", F.floor(F.col(s) / stretch))
    keys = [*by, "_stretch"]
    earlier = W.partitionBy(*by).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    tops = rows.groupBy(*keys).agg(F.max(e).alias("_top")).select(*keys, F.max("_top").over(earlier).alias("_carried"))
    order = W.partitionBy(*keys).orderBy(s, e)
    reach = F.max(e).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(tops, keys).withColumn("_reach", F.greatest(reach, "_carried"))
    rows = rows.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(s) > F.col("_reach") + gap), 1).otherwise(0))
    rows = rows.withColumn("_k", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    begun = rows.groupBy(*keys).agg(F.sum("_new").alias("_begun")).select(*keys, F.coalesce(F.sum("_begun").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(begun, keys).withColumn(name, F.col("_k") + F.col("_before")).drop("_stretch", "_carried", "_reach", "_new", "_k", "_before")
