"""Interval joins, sweeps and exon splitting over DataFrames.

The interval join deals both sides into bins of one width and joins on (chromosome, bin); of the bins that a pair shares,
only the first counts, so no distinct is needed. It is an equi-join that Spark can sort, split when skewed, or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordering import sweep


def interval_join(left: DataFrame, right: DataFrame, by: str = "chr", ls: str = "s", le: str = "e", rs: str = "rs", re: str = "re", width: int = 4096, how: str = "inner") -> DataFrame:
    """Pairs whose closed intervals overlap on the same `by`; how is inner, left or left_anti. Column names of the sides must differ, but for `by`."""
    if how != "inner":
        key = F.monotonically_increasing_id()
        left = left.withColumn("_row", key)
        pairs = interval_join(left, right, by, ls, le, rs, re, width)
        if how == "left_anti":
            return left.join(pairs.select("_row").distinct(), "_row", "left_anti").drop("_row")
        return pairs.unionByName(left.join(pairs.select("_row").distinct(), "_row", "left_anti"), allowMissingColumns=True).drop("_row")
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    a = left.where(F.col(ls) <= F.col(le)).withColumn("_bin", bins(ls, le))
    b = right.where(F.col(rs) <= F.col(re)).withColumn("_bin", bins(rs, re))
    pairs = a.join(b, [by, "_bin"])
    first = F.greatest(F.floor(F.col(ls) / width), F.floor(F.col(rs) / width))
    return pairs.where((F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) & (F.col("_bin") == first)).drop("_bin")


def point_join(points: DataFrame, intervals: DataFrame, by: str = "chr", pos: str = "pos", rs: str = "rs", re: str = "re", window: int = 0, width: int = 4096) -> DataFrame:
    """Points with the intervals that come within `window` of them."""
    near = points.withColumn("_ls", F.col(pos) - window).withColumn("_le", F.col(pos) + window)
    return interval_join(near, intervals, by, "_ls", "_le", rs, re, width).drop("_ls", "_le")


def islands(df: DataFrame, by: list[str], s: str = "s", e: str = "e", gap: int = 0, name: str = "island") -> DataFrame:
    """Numbers groups of intervals that overlap, or lie within `gap`, directly or through others; numbers count from 1 within `by`.

    Groups within a chromosome are found in two levels; smaller ones, such as genes, by a window."""
    if "chr" in by:
        return sweep(df, by, s, e, gap, name)
    order = W.partitionBy(*by).orderBy(s, e)
    reach = F.max(e).over(order.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(reach.isNull() | (F.col(s) > reach + gap), 1).otherwise(0)).withColumn(name, F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def island_bounds(df: DataFrame, by: list[str], s: str = "s", e: str = "e", gap: int = 0) -> DataFrame:
    return islands(df, by, s, e, gap).groupBy(*by, "island").agg(F.min(s).alias("island_s"), F.max(e).alias("island_e"), F.count("*").alias("n"))


def regions(alignments: DataFrame, genes: DataFrame | None = None, by: str = "chr") -> DataFrame:
    """Regions of alignments (chr, s, e): overlapping ones form a region, and a gene (chr, s, e) that spans a gap bridges it."""
    rows = alignments.select(by, "s", "e", F.lit(1).alias("read"))
    if genes is not None:
        rows = rows.unionAll(genes.select(by, "s", "e", F.lit(0).alias("read")))
    found = islands(rows, [by]).where("read = 1")
    return found.groupBy(by, "island").agg(F.min("s").alias("region_s"), F.max("e").alias("region_e"), F.count("*").alias("n_reads"))


def split_exons(exons: DataFrame, by: list[str], s: str = "s", e: str = "e") -> DataFrame:
    """Elementary blocks: exons cut at every border of any exon of the group; parts outside all exons are left out."""
    edges = exons.select(*by, F.col(s).alias("at"), F.lit(1).alias("step")).unionAll(exons.select(*by, (F.col(e) + 1).alias("at"), F.lit(-1).alias("step")))
    edges = edges.groupBy(*by, "at").agg(F.sum("step").alias("step"))
    order = W.partitionBy(*by).orderBy("at")
    open_ = edges.withColumn("depth", F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(order))
    return open_.where("depth > 0").select(*by, F.col("at").alias("s"), (F.col("next") - 1).alias("e"))


def transcripts(exons: DataFrame, keys: list[str]) -> DataFrame:
    """One row per transcript: exons as a sorted block list, and its introns, span and number of exons."""
    from ..functions import intervals as I

    rows = exons.groupBy(*keys).agg(F.array_sort(F.collect_list(I.iv("s", "e"))).alias("exons"))
    return rows.withColumn("introns", I.junctions(F.col("exons"))).withColumn("span", I.region(F.col("exons"))).withColumn("n_exons", F.size("exons"))


def coverage_valleys(bins: DataFrame, by: list[str], pos: str = "bin", n: str = "n", share: float = 0.01, least: int = 1) -> DataFrame:
    """Bins at which a region may be cut: covered by at most max(least, share of the region's maximum), and not more than their neighbours."""
    whole = W.partitionBy(*by)
    order = whole.orderBy(pos)
    top = F.greatest(F.lit(least), F.floor(F.max(n).over(whole) * share))
    before, after = F.lag(n, 1, 1 << 30).over(order), F.lead(n, 1, 1 << 30).over(order)
    return bins.withColumn("_top", top).withColumn("_b", before).withColumn("_a", after).where((F.col(n) <= F.col("_top")) & (F.col(n) <= F.col("_b")) & (F.col(n) <= F.col("_a"))).drop("_top", "_b", "_a")


def every_kth(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Coverage cap: of a group of more than `most` rows, every k-th in order stays, k = ceil(size / most). Groups are numbered by a window."""
    whole = W.partitionBy(*by)
    k = F.ceil(F.count("*").over(whole) / F.lit(most))
    return df.withColumn("_k", k).withColumn("_n", F.row_number().over(whole.orderBy(*order)) - 1).where("_n % _k = 0").drop("_k", "_n")


def filter_alignments(df: DataFrame, least_mapq: int = 0, secondary: bool = False, chromosomes: list[str] | None = None) -> DataFrame:
    """Keeps primary (or, if wanted, secondary) alignments of a mapping quality, on given chromosomes."""
    keep = F.col("mapq") >= least_mapq
    if not secondary:
        keep &= ~F.col("is_secondary")
    return df.where(keep & F.col("chr").isin(*chromosomes) if chromosomes else keep)


def drop_simple_intergenic(df: DataFrame, n_blocks: Column, intergenic: Column) -> DataFrame:
    """Outside genes, alignments of at most two blocks that are secondary or have no mapping quality go."""
    return df.where(~(intergenic & (n_blocks <= 2) & (F.col("is_secondary") | (F.col("mapq") < 1))))
