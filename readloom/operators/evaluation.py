"""Ranking of genes between conditions, and agreement of results with a truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordering import running_before


def value_sums(counts: DataFrame, feature: str, group: str, value: str = "count", least: float = 5.0) -> DataFrame:
    """Sums per feature and group, of features that reach `least` in some group."""
    sums = counts.groupBy(feature, group).agg(F.sum(value).alias("value"))
    return sums.withColumn("_m", F.max("value").over(W.partitionBy(feature))).where(F.col("_m") >= least).drop("_m")


def usage_deviance(counts: DataFrame, gene: str, isoform: str, condition: str, a: str, b: str, value: str = "count") -> DataFrame:
    """Distance of isoform-usage fractions of two conditions per gene; 0.7 of it where the gene has one isoform."""
    wide = counts.where(F.col(condition).isin(a, b)).groupBy(gene, isoform).agg(F.sum(F.when(F.col(condition) == a, F.col(value)).otherwise(0)).alias("va"), F.sum(F.when(F.col(condition) == b, F.col(value)).otherwise(0)).alias("vb"))
    w = W.partitionBy(gene)
    part = lambda c: F.when(F.sum(c).over(w) > 0, F.col(c) / F.sum(c).over(w)).otherwise(0.0)
    rows = wide.withColumn("fa", part("va")).withColumn("fb", part("vb"))
    out = rows.groupBy(gene).agg(F.sqrt(F.sum((F.col("fa") - F.col("fb")) ** 2)).alias("deviance"), F.count("*").alias("n_isoforms"), F.sum("va").alias("total_a"), F.sum("vb").alias("total_b"))
    return out.withColumn("deviance", F.col("deviance") * F.when(F.col("n_isoforms") == 1, 0.7).otherwise(1.0))


def average_rank(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Rank from 1 in ascending order, ties get their mean. Ranks come from counts of distinct values, so that no window holds all rows:
    only the distinct values are ordered, and without groups in ranges."""
    by = by or []
    values = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranks = running_before(values, by, value, "_c", "_before").withColumn(name, F.col("_before") + (F.col("_c") + 1) / 2.0).drop("_c", "_before")
    return df.join(ranks, [*by, value])


def gene_ranking(deviance: DataFrame, gene: str) -> DataFrame:
    """Sum of average ranks of mean value, absolute difference and deviance; larger is more interesting."""
    rows = deviance.withColumn("mean_value", (F.col("total_a") + F.col("total_b")) / 2.0).withColumn("difference", F.abs(F.col("total_a") - F.col("total_b")).cast("double")).withColumn("deviance", F.round("deviance", 9))
    for value in ("mean_value", "difference", "deviance"):
        rows = average_rank(rows, value, f"rank_{value}")
    return rows.withColumn("rank_sum", F.col("rank_mean_value") + F.col("rank_difference") + F.col("rank_deviance")).select(gene, "mean_value", "difference", "deviance", "rank_sum")


def count_agreement(observed: DataFrame, expected: DataFrame, feature: str) -> DataFrame:
    """Correlation, matches within 0, 10 and 20 percent, missed and false features of two count tables."""
    both = observed.select(feature, F.col("count").alias("o")).join(expected.select(feature, F.col("count").alias("x")), feature, "full").fillna(0.0, ["o", "x"])
    hit = lambda share: F.count_if((F.col("x") > 0) & (F.abs(F.col("o") - F.col("x")) <= share * F.col("x")))
    return both.agg(F.corr("o", "x").alias("correlation"), hit(0.0).alias("exact"), hit(0.1).alias("within_10"), hit(0.2).alias("within_20"), F.count_if((F.col("x") > 0) & (F.col("o") == 0)).alias("missed"), F.count_if((F.col("x") == 0) & (F.col("o") > 0)).alias("false_features"))


def deviation_histogram(observed: DataFrame, expected: DataFrame, feature: str) -> DataFrame:
    """Observed in percent of expected, in bins of 10 to 200, then one bin."""
    both = observed.select(feature, F.col("count").alias("o")).join(expected.select(feature, F.col("count").alias("x")), feature).where("x > 0")
    share = 100.0 * F.col("o") / F.col("x")
    return both.select(F.when(share >= 200, 200).otherwise(F.floor(share / 10) * 10).cast("bigint").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def nearest_sites(predicted: DataFrame, truth: DataFrame, by: list[str], within: int) -> DataFrame:
    """Each predicted position with its nearest true one of the group, the smaller of equals; null beyond `within`."""
    sites = truth.groupBy(*by).agg(F.array_sort(F.collect_set("pos")).alias("_sites"))
    near = F.array_min(F.transform("_sites", lambda s: F.struct(F.abs(s - F.col("pos")).alias("d"), s.alias("s"))))
    rows = predicted.join(sites, by, "left").withColumn("_n", near)
    return rows.withColumn("site", F.when(F.col("_n.d") <= within, F.col("_n.s"))).withColumn("distance", F.when(F.col("_n.d") <= within, F.col("_n.d"))).drop("_sites", "_n")


def site_scores(matched: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Precision over predictions, recall over true sites that some prediction hit."""
    hit = matched.where("site is not null").select(*by, F.col("site").alias("pos")).distinct().agg(F.count("*").alias("found"))
    n = matched.agg(F.count("*").alias("predicted"), F.count("site").alias("correct")).crossJoin(truth.select(*by, "pos").distinct().agg(F.count("*").alias("sites"))).crossJoin(hit)  # one row each
    return n.withColumn("precision", F.col("correct") / F.col("predicted")).withColumn("recall", F.col("found") / F.col("sites"))


def annotation_stats(transcripts: DataFrame) -> DataFrame:
    """Per gene: transcripts, exons, introns, mean transcript length. transcripts: gene_id, exons, introns."""
    length = F.aggregate("exons", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"] + 1)
    return transcripts.withColumn("_l", length).groupBy("gene_id").agg(F.count("*").alias("n_transcripts"), F.sum(F.size("exons")).alias("n_exons"), F.sum(F.size("introns")).alias("n_introns"), F.avg("_l").alias("mean_length"))


def lengths(transcripts: DataFrame) -> DataFrame:
    """(kind, length, n): how many exons, introns and transcripts have which length, each exon and intron once per place."""
    size = lambda x: x["e"] - x["s"] + 1
    part = lambda c, kind: transcripts.select("chr", "strand", F.explode(c).alias("x")).distinct().select(F.lit(kind).alias("kind"), size(F.col("x")).alias("length"))
    whole = transcripts.select(F.lit("transcript").alias("kind"), F.aggregate("exons", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"] + 1).alias("length"))
    return part("exons", "exon").unionAll(part("introns", "intron")).unionAll(whole).groupBy("kind", "length").agg(F.count("*").alias("n"))


def motif_counts(introns: DataFrame) -> DataFrame:
    """(motif, n): first and last two bases of introns (left, right: sequences at their ends; strand), read on their strand."""
    rev = lambda c: F.reverse(F.translate(F.upper(c), "ACGT", "TGCA"))
    minus = F.col("strand") == "-"
    left, right = F.upper(F.substring("left", 1, 2)), F.upper(F.right("right", F.lit(2)))
    motif = F.when(minus, F.concat_ws("-", rev(right), rev(left))).otherwise(F.concat_ws("-", left, right))
    return introns.groupBy(motif.alias("motif")).agg(F.count("*").alias("n"))
