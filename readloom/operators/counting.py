"""Counting features by groups: weights, confirmation, TPM, inclusion and exclusion, region cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordering import numbered

#: What each strategy counts: (ambiguous reads, minor inconsistencies, inconsistent reads, only full matches).
STRATEGIES = {
    "unique_only": (False, False, False, False),
    "with_ambiguous": (True, False, False, False),
    "fsm_only": (False, False, False, True),
    "unique_splicing_consistent": (False, True, False, False),
    "unique_inconsistent": (False, True, True, False),
    "all": (True, True, True, False),
}


def weights(strategy: str, kind: Column, n_features: Column, full_match: Column | None = None) -> Column:
    """Weight of one (read, feature) row.

    Unique reads weigh 1 (with fsm_only: if they match in full). Ambiguous reads weigh 1 if one feature is left, else 1/n
    where the strategy counts them. Inconsistent reads weigh 1 where it counts them (or only minor ones), and 1/n with
    several features where it counts both kinds. kind is the assignment type; n_features the read's number of features."""
    ambiguous, minor, inconsistent, full = STRATEGIES[strategy]
    share = F.lit(1.0) / n_features
    unique = F.when(full_match, 1.0).otherwise(0.0) if full and full_match is not None else F.lit(0.0 if full else 1.0)
    several = kind.isin("inconsistent_ambiguous", "inconsistent_multigenic") | (n_features > 1)
    w = F.when(kind.isin("unique", "unique_minor_difference"), unique)
    w = w.when(kind == "ambiguous", F.when(n_features == 0, 0.0).when(n_features == 1, 1.0).otherwise(share if ambiguous else F.lit(0.0)))
    w = w.when(kind.startswith("inconsistent") & several, share if ambiguous and inconsistent else F.lit(0.0))
    w = w.when(kind.startswith("inconsistent") & (F.lit(inconsistent) | (F.lit(minor) & (kind == "inconsistent_non_intronic"))), 1.0)
    return w.otherwise(0.0)


def count_features(reads: DataFrame, feature: str, weight: Column, group: list[str] | None = None, confirm: Column | None = None) -> DataFrame:
    """Sum of weights per feature and group; a feature that no read of any group confirms counts 0."""
    group = group or []
    rows = reads.withColumn("_w", weight).withColumn("_c", F.coalesce(confirm, F.lit(True)) if confirm is not None else F.lit(True))
    per = rows.groupBy(feature, *group).agg(F.sum("_w").alias("count"), F.max("_c").alias("_c"))
    if confirm is not None and group:
        per = per.withColumn("_c", F.max("_c").over(W.partitionBy(feature)))
    return per.withColumn("count", F.when(F.col("_c"), F.col("count")).otherwise(0.0)).drop("_c")


def complete(counts: DataFrame, features: DataFrame, feature: str) -> DataFrame:
    """A row for every known feature, 0 where nothing was counted."""
    return features.select(feature).distinct().join(counts, feature, "left").withColumn("count", F.coalesce("count", F.lit(0.0)))


def tpm(counts: DataFrame, group: list[str] | None = None, usable: DataFrame | None = None) -> DataFrame:
    """Counts per million of the group's counted reads, or of its usable reads (group..., usable)."""
    group = group or []
    totals = usable if usable is not None else counts.groupBy(*group).agg(F.sum("count").alias("usable"))
    joined = counts.join(totals, group) if group else counts.crossJoin(F.broadcast(totals))  # without groups: one row
    return joined.withColumn("tpm", F.when(F.col("usable") > 0, F.col("count") * 1e6 / F.col("usable")).otherwise(0.0)).drop("usable")


def by_strategies(reads: DataFrame, strategies: dict[str, Column]) -> DataFrame:
    """Each read once for each grouping strategy: (strategy, group_id)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("strategy"), F.coalesce(v.cast("string"), F.lit("NA")).alias("group_id")) for k, v in strategies.items()])
    return reads.withColumn("_g", F.explode(pairs)).select("*", "_g.strategy", "_g.group_id").drop("_g")


def inclusion(reads: DataFrame, features: DataFrame, read_key: str, margin: int = 0, delta: int = 0) -> DataFrame:
    """Reads (key, gene_id, chr, strand, s, e, introns) against intron features (gene_id, fs, fe): included where an intron equals
    the feature within delta; excluded where the feature lies inside the read, overlapping what the read does not splice out."""
    same = F.exists("introns", lambda i: (F.abs(i["s"] - F.col("fs")) <= delta) & (F.abs(i["e"] - F.col("fe")) <= delta))
    inside = (F.col("fs") >= F.col("s") + margin) & (F.col("fe") <= F.col("e") - margin)
    joined = reads.join(features, ["gene_id"])
    return joined.withColumn("state", F.when(same, 1).when(inside, -1).otherwise(0)).where("state != 0").select(read_key, *[c for c in features.columns], "state")


def include_exclude(states: DataFrame, keys: list[str], group: list[str] | None = None) -> DataFrame:
    return states.groupBy(*keys, *(group or [])).agg(F.count_if(F.col("state") == 1).alias("include_counts"), F.count_if(F.col("state") == -1).alias("exclude_counts"))


def splice_site_cascade(pairs: DataFrame, keys: list[str], margin: int = 50, delta: int = 0) -> DataFrame:
    """Per region: reads that hold it in full, only its left or right edge, or splice over it; the first that fits counts.

    pairs: keys, region (rs, re), read span (s, e), read blocks."""
    left = F.exists("blocks", lambda b: (F.abs(b["s"] - F.col("rs")) <= delta) & (b["e"] >= F.col("rs")))
    right = F.exists("blocks", lambda b: (F.abs(b["e"] - F.col("re")) <= delta) & (b["s"] <= F.col("re")))
    full = F.exists("blocks", lambda b: (F.abs(b["s"] - F.col("rs")) <= delta) & (F.abs(b["e"] - F.col("re")) <= delta))
    covered = F.exists("blocks", lambda b: (b["s"] <= F.col("re")) & (b["e"] >= F.col("rs")))
    over = (F.col("s") <= F.col("rs") - margin) & (F.col("e") >= F.col("re") + margin) & ~covered
    kind = F.when(full, "full").when(left & ~right, "left").when(right & ~left, "right").when(over, "exclusion").when(covered, "ambiguous")
    rows = pairs.withColumn("kind", kind).where("kind is not null")
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("full", "left", "right", "exclusion", "ambiguous")])


def joint_exon_regions(pairs: DataFrame, keys: list[str], read_key: str) -> DataFrame:
    """(region, exon) × read states (1, -1, 0) to counts: a read with any unknown variant of a region is ignored; each included
    variant counts; a read that lacks all variants counts for the region's exclusion (exon null)."""
    per_read = W.partitionBy(*keys, read_key)
    rows = pairs.withColumn("_lo", F.min(F.abs("state")).over(per_read)).withColumn("_hi", F.max("state").over(per_read)).where("_lo > 0")
    inc = rows.where("state = 1").groupBy(*keys, "exon_s", "exon_e").agg(F.count("*").alias("count"))
    exc = rows.where("_hi = -1").groupBy(*keys).agg(F.count_distinct(read_key).alias("count"))
    return inc.unionByName(exc, allowMissingColumns=True)


def usable_reads(reads: DataFrame, group: list[str]) -> DataFrame:
    return reads.groupBy(*group).agg(F.count("*").alias("usable"))


def type_stats(reads: DataFrame, kind: str) -> DataFrame:
    return reads.groupBy(kind).agg(F.count("*").alias("n"))


def matrix(counts: DataFrame, feature: str, group: str, values: list[str], value: str = "count") -> DataFrame:
    """Features by groups; values are the group ids (given, so that no extra job runs and the width is known)."""
    return counts.groupBy(feature).pivot(group, values).agg(F.sum(value)).fillna(0)


def matrix_market(counts: DataFrame, feature: str, group: str) -> DataFrame:
    """(row, column, count) with dense ids from 1 in sorted order. Ids come from the distinct names, not from the entries."""
    ids = lambda c, name: numbered(counts.select(c).distinct(), [c], name).withColumn(name, F.col(name).cast("int"))
    return counts.where("count != 0").join(ids(feature, "row"), feature).join(ids(group, "column"), group).select("row", "column", "count")


def include_exclude_matrices(counts: DataFrame, feature: str, group: str) -> DataFrame:
    """(kind, row, column, count): the included and the excluded counts as two sparse matrices over common ids; zeros are left out."""
    ids = lambda c, name: numbered(counts.select(c).distinct(), [c], name).withColumn(name, F.col(name).cast("int"))
    rows = counts.join(ids(feature, "row"), feature).join(ids(group, "column"), group)
    pairs = F.array(F.struct(F.lit("include").alias("kind"), F.col("include_counts").alias("count")), F.struct(F.lit("exclude").alias("kind"), F.col("exclude_counts").alias("count")))
    return rows.select("row", "column", F.explode(pairs).alias("p")).select("p.kind", "row", "column", "p.count").where("count != 0")


def include_exclude_cells(counts: DataFrame, feature: list[str], group: str, values: list[str]) -> DataFrame:
    """Cells "included,excluded" of features by groups."""
    cells = counts.withColumn("cell", F.concat_ws(",", F.col("include_counts").cast("string"), F.col("exclude_counts").cast("string")))
    return cells.groupBy(*feature).pivot(group, values).agg(F.first("cell")).fillna("0,0")


# ---------------------------------------------------------------- what counts


def counts_for_genes(gene_kind: Column) -> Column:
    """Reads of one gene; unassigned and ambiguous ones count for none."""
    return gene_kind.isNotNull() & ~gene_kind.isin("noninformative", "intergenic", "suspended", "ambiguous", "inconsistent_ambiguous")


def drop_poor_inconsistent(reads: DataFrame, least_mapq: int = 5, kind: str = "assignment_type") -> DataFrame:
    """Inconsistent reads of low mapping quality go, after classification."""
    return reads.where(~(F.col(kind).startswith("inconsistent") & (F.col("mapq") < least_mapq)))


def counts_for_ends(kind: Column, polya: Column, stranded: bool = False) -> Column:
    """Reads that terminal counters take: of four assignment types, with a tail or from stranded data."""
    return kind.isin("unique", "unique_minor_difference", "ambiguous", "inconsistent_non_intronic") & (polya | F.lit(stranded))


def retained_introns(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Reads per intron that an isoform of theirs has and they retain. matches: events (event, iso_lo, iso_hi), tx_introns, gene_assignment_type."""
    kept = F.filter("events", lambda e: e["event"].isin("intron_retention", "unspliced_intron_retention") & (e["iso_lo"] >= 0))
    introns = F.flatten(F.transform(kept, lambda e: F.slice("tx_introns", e["iso_lo"] + 1, e["iso_hi"] - e["iso_lo"] + 1)))
    rows = matches.where(counts_for_genes(F.col("gene_assignment_type"))).select(*keys, F.explode(introns).alias("i"))
    return rows.groupBy(*keys, "i.s", "i.e").agg(F.count("*").alias("retained"))
