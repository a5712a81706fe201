"""Lookups and conversions: barcodes of reads, merged gene blocks, linked supplementary alignments, spots, ids, text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import intervals as I
from . import fusion as X
from .ordering import numbered
from .regions import islands


def with_barcodes(reads: DataFrame, table: DataFrame) -> DataFrame:
    """Reads with the barcode and UMI of a table (read_id, barcode, umi); null where it has none. Repeated read ids of the table give
    their first pair in order."""
    one = table.groupBy("read_id").agg(F.min(F.struct("barcode", "umi")).alias("_b"))
    return reads.drop("barcode", "umi").join(one, "read_id", "left").withColumn("barcode", F.col("_b.barcode")).withColumn("umi", F.col("_b.umi")).drop("_b")


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of genes (chr, s, e, genes) that overlap become one, with all their genes."""
    rows = islands(blocks, ["chr"], name="block")
    return rows.groupBy("chr", "block").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("genes")))).alias("genes"), F.count("*").alias("n_blocks"))


def linked_alignments(primary: DataFrame, least_length: int = 40, least_mapq: int = 10, most: int = 3) -> DataFrame:
    """One row per primary alignment and chosen supplementary one of its tag. primary: read_id, chr, pos, cigar, sa."""
    entries = X.best_supplementary(X.parse_sa(F.col("sa")), least_length, least_mapq, most)
    rows = primary.where(F.col("sa").isNotNull()).select("read_id", F.col("chr").alias("left_chr"), X.breakpoint(F.col("pos"), F.col("cigar")).alias("left_pos"), F.posexplode(entries).alias("rank", "x"))
    return rows.select("read_id", "rank", "left_chr", "left_pos", F.col("x.chr").alias("right_chr"), X.breakpoint(F.col("x.pos"), F.col("x.cigar")).alias("right_pos"), F.col("x.strand").alias("right_strand"), F.col("x.mapq").alias("right_mapq"))


# ---------------------------------------------------------------- ids


def new_ids(features: DataFrame, taken: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Features numbered in order by the least positive numbers that are not taken (column id of `taken`).

    The k-th free number is k plus the taken numbers below it. A taken number t leaves t - (its rank) free ones before it, so the
    ones below the k-th free number are those of which fewer than k free ones come before: a join on ranges of that shift."""
    rows = numbered(features, order, "_k")
    used = numbered(taken.select(F.col("id").cast("bigint").alias("id")).where("id > 0").distinct(), ["id"], "_rank")
    steps = used.withColumn("_free", F.col("id") - F.col("_rank")).groupBy("_free").agg(F.max("_rank").alias("_shift"))
    both = rows.select(F.col("_k").alias("_at"), F.lit(0).alias("_shift"), F.lit(1).alias("_own")).unionByName(steps.select((F.col("_free") + 1).alias("_at"), "_shift", F.lit(0).alias("_own")))
    placed = numbered(both, ["_at", "_own"], "_row")
    stretch = placed.withColumn("_part", F.floor(F.col("_row") / (1 << 20)))
    tops = stretch.groupBy("_part").agg(F.max("_shift").alias("_top"))
    carried = tops.select("_part", F.coalesce(F.max("_top").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_carried"))
    inner = F.max("_shift").over(W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0))
    shifts = stretch.withColumn("_inner", inner).join(F.broadcast(carried), "_part").where("_own = 1").select(F.col("_at").alias("_k"), F.greatest("_inner", "_carried").alias("_s"))
    return rows.join(shifts, "_k").withColumn(name, F.col("_k") + F.col("_s")).drop("_k", "_s")


def feature_ids(features: DataFrame, known: DataFrame) -> DataFrame:
    """Features (chr, s, e, strand) with the id of an equal known one, else chr.number, numbered per chromosome over the new ones."""
    place = ["chr", "s", "e", "strand"]
    rows = features.select(*place).distinct().join(known.groupBy(*place).agg(F.min("feature_id").alias("_known")), place, "left")
    nth = F.row_number().over(W.partitionBy("chr", F.col("_known").isNull()).orderBy("s", "e", "strand"))
    return rows.withColumn("feature_id", F.coalesce("_known", F.concat(F.col("chr"), F.lit("."), nth.cast("string")))).drop("_known")


# ---------------------------------------------------------------- text forms


def read_type(kind: Column) -> Column:
    """Assignment type as known, known_ambiguous, novel or none."""
    return F.when(kind.isin("unique", "unique_minor_difference"), "known").when(kind == "ambiguous", "known_ambiguous").when(kind.startswith("inconsistent"), "novel").otherwise("none")


def coordinate(chrom: Column, s: Column, e: Column, strand: Column) -> Column:
    return F.concat_ws("_", chrom, s.cast("string"), e.cast("string"), strand)


def intron_coordinates(exons: Column, chrom: Column, strand: Column) -> Column:
    """Introns of a text of exons (s-e,s-e) as coordinates, each after ;%;."""
    introns = I.junctions(I.text_to_blocks(F.when(exons == ".", "").otherwise(exons)))
    return F.concat(F.lit(";%;"), F.array_join(F.transform(introns, lambda x: coordinate(chrom, x["s"], x["e"], strand)), ";%;"))


def additional_info(gene_kind: Column, polya: Column, cage: Column, canonical: Column, classification: Column, more: Column) -> Column:
    """The attribute text of the older table of assignments; dots are left out."""
    part = lambda name, c: F.when(c != ".", F.concat(F.lit(f"{name}="), c, F.lit(";")))
    always = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit(".")), F.lit(";"))
    return F.concat_ws(" ", always("gene_assignment", gene_kind), always("PolyA", polya), part("CAGE", cage), part("Canonical", canonical), always("Classification", classification), F.when(~more.isin("*", "."), more))


def group_lists(counts: DataFrame, feature: str, group: str, values: list[str]) -> DataFrame:
    """Counts per feature and group to a list per value that holds each group as often as it was counted, in order of groups."""
    rows = counts.groupBy(feature).agg(*[F.sum(v).alias(f"n_{v}") for v in values], F.array_sort(F.collect_list(F.struct(F.col(group).cast("string").alias("g"), *values))).alias("_l"))

    def repeated(v: str) -> Column:
        return F.array_join(F.flatten(F.transform("_l", lambda x: F.array_repeat(x["g"], x[v].cast("int")))), ",").alias(f"groups_{v}")

    lists = [repeated(v) for v in values]
    return rows.select(feature, *[f"n_{v}" for v in values], *lists)


def spots_of_parts(reads: DataFrame, barcode: str, first: DataFrame, second: DataFrame, spots: DataFrame) -> DataFrame:
    """Barcodes of two parts (a|b) to spot ids of three sizes, * where there is none. first: part, y; second: part, x; spots:
    spot_2um, spot_8um, spot_16um (without suffixes). The lists are those of a chip, and so small."""
    parts = F.split(F.col(barcode), r"\|")
    rows = reads.withColumn("_a", F.when(F.size(parts) == 2, parts[0])).withColumn("_b", F.when(F.size(parts) == 2, parts[1]))
    rows = rows.join(first.select(F.col("part").alias("_a"), F.col("y").alias("_y")), "_a", "left").join(second.select(F.col("part").alias("_b"), F.col("x").alias("_x")), "_b", "left")
    rows = rows.withColumn("_2", F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), F.concat_ws("_", F.lit("s_002um"), F.col("_x").cast("string"), F.col("_y").cast("string"))))
    rows = rows.join(spots.select(F.col("spot_2um").alias("_2"), "spot_8um", "spot_16um"), "_2", "left")
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    return rows.withColumn("spot_2um", star("_2")).withColumn("spot_8um", star("spot_8um")).withColumn("spot_16um", star("spot_16um")).drop("_a", "_b", "_x", "_y", "_2")
