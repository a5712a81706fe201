"""The bulk run as one plan: annotation and alignments in, assignments, counts and models out.

alignments ⋈ genes (interval join) → classified (read × isoform) → resolved by read (windows) → exploded to features and
groups → aggregated. Nothing is collected; every output is a distributed write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import classify, counting, discovery, multimap
from ..operators.regions import filter_alignments, interval_join
from ..operators.regions import transcripts as to_transcripts
from ..params import DISCOVERY, MATCHING
from ..sources import readers, sinks


@dataclass
class Results:
    assignments: DataFrame
    gene_counts: DataFrame
    transcript_counts: DataFrame
    models: DataFrame


def alignment_blocks(sam: DataFrame) -> DataFrame:
    """Alignments of SAM rows with blocks, introns and span; unmapped and supplementary ones go."""
    rows = sam.where(~F.col("unmapped") & ~F.col("is_supplementary")).withColumn("blocks", readers.cigar_blocks(F.col("pos"), F.col("cigar"))).where(F.size("blocks") > 0)
    rows = rows.withColumn("introns", I.junctions(F.col("blocks"))).withColumn("span", I.region(F.col("blocks")))
    key = F.concat_ws(":", "read_id", "chr", F.col("pos").cast("string"), F.col("flag").cast("string"), "cigar")
    return rows.withColumn("aln_id", key).withColumn("s", F.col("span.s")).withColumn("e", F.col("span.e"))


def analyze(alignments: DataFrame, exons: DataFrame, preset: str = "default", gene_strategy: str = "unique_splicing_consistent", transcript_strategy: str = "unique_only", group: str | None = None, least_mapq: int = 0, secondary: bool = False, models: str = "default_ont", least_inconsistent_mapq: int = 5) -> Results:
    """alignments: aln_id, read_id, chr, s, e, blocks, introns, span, mapq, is_secondary (and the group column)."""
    if preset not in MATCHING or models not in DISCOVERY:
        raise ValueError("unknown preset")
    reads = filter_alignments(alignments, least_mapq, secondary)
    tx = to_transcripts(exons, ["tx_id", "gene_id", "chr", "strand"])
    genes = exons.groupBy("gene_id", "chr").agg(F.min("s").alias("rs"), F.max("e").alias("re"))
    near = interval_join(reads.select("aln_id", "chr", "s", "e", "blocks", "introns", "span"), genes)
    found = classify.classify(near.select("aln_id", "gene_id", "blocks", "introns", "span"), tx, preset)
    best = found.groupBy("aln_id").agg(F.first("assignment_type").alias("assignment_type"), F.first("gene_assignment_type").alias("gene_assignment_type"), F.sort_array(F.collect_set("tx_id")).alias("tx_ids"), F.sort_array(F.collect_set("gene_id")).alias("gene_ids"), F.min("penalty").alias("penalty"))
    common = F.least("e", "re") - F.greatest("s", "rs") + 1
    overlap = near.groupBy("aln_id").agg(F.min("rs").alias("region_s"), F.max(common).alias("overlap"))
    rows = reads.join(best, "aln_id", "left").join(overlap, "aln_id", "left")
    rows = rows.withColumn("assignment_type", F.coalesce("assignment_type", F.when(F.col("region_s").isNull(), "intergenic").otherwise("noninformative"))).withColumn("gene_assignment_type", F.coalesce("gene_assignment_type", "assignment_type"))
    rows = rows.withColumn("isoform_id", F.array_join("tx_ids", ",")).withColumn("gene_id", F.array_join("gene_ids", ",")).withColumn("is_primary", ~F.col("is_secondary")).withColumn("overlap", F.coalesce("overlap", F.lit(0))).withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    rows = counting.drop_poor_inconsistent(rows, least_inconsistent_mapq)
    resolved = multimap.resolve(rows).where("kept").withColumn("assignment_type", F.when(F.col("resolved_type").endswith("ambiguous") & ~F.col("assignment_type").endswith("ambiguous"), F.col("resolved_type")).otherwise(F.col("assignment_type")))
    groups = [group] if group else []

    def counts(ids: str, feature: str, kind: str, strategy: str) -> DataFrame:
        each = resolved.where(F.size(ids) > 0).withColumn("n_features", F.size(ids)).withColumn(feature, F.explode(ids))
        confirm = F.col(kind).isin("unique", "unique_minor_difference") & (F.lit(feature == "gene") | (F.size("blocks") > 1))
        return counting.tpm(counting.count_features(each, feature, counting.weights(strategy, F.col(kind), F.col("n_features")), groups, confirm), groups)

    rows_of = resolved.where(F.size("gene_ids") == 1).select("chr", "introns", F.element_at("gene_ids", 1).alias("gene_id"))
    chains = discovery.chain_models(rows_of, tx, DISCOVERY[models].min_novel_count, DISCOVERY[models].min_known_count)
    return Results(resolved, counts("gene_ids", "gene", "gene_assignment_type", gene_strategy), counts("tx_ids", "transcript", "assignment_type", transcript_strategy), chains)


def run(spark: SparkSession, gtf: str, sam: list[str], out: str, **options) -> Results:
    """Reads a GTF and SAM texts, writes assignments, counts and models under `out`, and returns them."""
    exons = readers.exons_of(readers.read_gtf(spark, gtf))
    files = [alignment_blocks(readers.read_sam(spark, p)).withColumn("file_group", F.lit(k)) for k, p in enumerate(sam)]
    rows = files[0]
    for f in files[1:]:
        rows = rows.unionByName(f)
    found = analyze(rows, exons, **options)
    line = found.assignments.select("read_id", "chr", "gene_id", "isoform_id", "assignment_type", "gene_assignment_type", I.blocks_to_text(F.col("blocks")).alias("exons"), F.round("penalty", 4).alias("penalty"))
    sinks.write_tsv(line, f"{out}/read_assignments")
    sinks.write_tsv(found.gene_counts, f"{out}/gene_counts")
    sinks.write_tsv(found.transcript_counts, f"{out}/transcript_counts")
    sinks.write_tsv(found.models, f"{out}/models")
    return found
