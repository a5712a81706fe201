"""Resolution of reads with several alignments: windows over one read at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Classes of candidates in the order in which they are taken.
PRIORITIES = ["primary_unique", "consistent", "primary_inconsistent", "inconsistent", "noninformative"]
CONSISTENT = ("unique", "unique_minor_difference", "ambiguous")
INCONSISTENT = ("inconsistent", "inconsistent_non_intronic", "inconsistent_ambiguous")


def priority(kind: str = "assignment_type", primary: str = "is_primary"):
    """1 for primary unique alignments, up to 5 for those that tell nothing."""
    k, p = F.col(kind), F.col(primary)
    return F.when(p & k.isin("unique", "unique_minor_difference"), 1).when(k.isin(*CONSISTENT), 2).when(p & k.isin(*INCONSISTENT), 3).when(k.isin(*INCONSISTENT), 4).otherwise(5)


def resolve(alignments: DataFrame, read: str = "read_id", scope: list[str] | None = None, mode: str = "take_best", penalty_mode: str = "reference_zero") -> DataFrame:
    """Adds kept and resolved_type. Input: read, aln_id, assignment_type, is_primary, isoform_id, gene_id, chr, s, e, overlap, region_s, penalty.

    mode: ignore (every alignment is kept), merge (all kept, ambiguous if they disagree), take_best. With take_best the best
    priority class of a read stays; inconsistent ones by least penalty (all tie in reference_zero mode); of alignments that
    tell nothing one stays, by overlap, then region start. Of equal kept alignments the first by aln_id stays."""
    keys = [*(scope or []), read]
    group = W.partitionBy(*keys)
    rows = alignments.withColumn("n_alignments", F.count("*").over(group)).withColumn("_p", priority())
    if mode == "ignore":
        return rows.withColumn("kept", F.lit(True)).withColumn("resolved_type", F.col("assignment_type")).drop("_p")
    if mode == "take_best":
        cost = F.col("penalty") if penalty_mode == "actual" else F.lit(0.0)
        rows = rows.withColumn("_best", F.min("_p").over(group)).withColumn("_cost", F.when(F.col("_p").isin(3, 4), cost).otherwise(0.0))
        rows = rows.withColumn("_r", F.rank().over(group.orderBy("_p", "_cost"))).withColumn("_first", F.row_number().over(group.orderBy("_p", F.desc("overlap"), "region_s", "aln_id")))
        rows = rows.withColumn("kept", (F.col("_p") == F.col("_best")) & F.when(F.col("_best") == 5, F.col("_first") == 1).otherwise(F.col("_r") == 1))
    else:
        rows = rows.withColumn("kept", F.lit(True))
    same = W.partitionBy(*keys, "kept", "chr", "s", "e", "isoform_id").orderBy("aln_id")
    rows = rows.withColumn("kept", F.col("kept") & (F.row_number().over(same) == 1))
    isoforms = F.size(F.collect_set(F.when(F.col("kept"), F.col("isoform_id"))).over(group))
    genes = F.size(F.collect_set(F.when(F.col("kept"), F.col("gene_id"))).over(group))
    several = (isoforms > 1) | (genes > 1)
    kind = F.col("assignment_type")
    told = F.when(~F.col("kept"), "suspended").when(several & kind.isin(*INCONSISTENT), "inconsistent_ambiguous").when(several & kind.isin(*CONSISTENT), "ambiguous").otherwise(kind)
    return rows.withColumn("resolved_type", told).drop("_p", "_best", "_cost", "_r", "_first")
