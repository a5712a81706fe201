"""Gene fusions from split alignments: parsing, breakpoints, aggregation, consensus, validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CLIP = 50
#: Biotypes that a fusion's genes must have.
BIOTYPES = ("protein_coding", "IG_C_gene", "IG_D_gene", "IG_J_gene", "IG_V_gene", "TR_C_gene", "TR_D_gene", "TR_J_gene", "TR_V_gene")


def cigar_length(cigar: Column, ops: str = "MX=") -> Column:
    """Bases of the given operations."""
    parts = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.aggregate(F.transform(parts, lambda p: p.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


def reference_length(cigar: Column) -> Column:
    return cigar_length(cigar, "MDN=X")


def clip_side(cigar: Column, least: int = CLIP) -> Column:
    """Side of the one soft clip of at least `least` bases; null if there is none or both are."""
    left = F.coalesce(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0)) >= least
    right = F.coalesce(F.regexp_extract(cigar, r"(\d+)S(?:\d+H)?$", 1).try_cast("int"), F.lit(0)) >= least
    return F.when(left & ~right, "left").when(right & ~left, "right")


def breakpoint(pos: Column, cigar: Column) -> Column:
    """Clipped end of an alignment: its start for a left clip, its end for a right clip, its middle otherwise."""
    end = pos + reference_length(cigar) - 1
    side = clip_side(cigar)
    return F.when(side == "left", pos).when(side == "right", end).otherwise(F.floor((pos + end) / 2))


def parse_sa(tag: Column) -> Column:
    """Entries chr,pos,strand,cigar,mapq,nm; of a supplementary-alignment tag, as structs."""
    parts = F.filter(F.transform(F.split(tag, ";"), lambda t: F.split(t, ",")), lambda p: F.size(p) >= 5)
    return F.transform(parts, lambda p: F.struct(p[0].alias("chr"), p[1].cast("bigint").alias("pos"), p[2].alias("strand"), p[3].alias("cigar"), p[4].cast("int").alias("mapq")))


def best_supplementary(entries: Column, least_length: int = 40, least_mapq: int = 10, most: int = 3) -> Column:
    """Entries of enough length and quality, the best three by (mapq, length)."""
    ok = F.filter(entries, lambda x: (cigar_length(x["cigar"]) >= least_length) & (x["mapq"] >= least_mapq))
    ranked = F.transform(ok, lambda x: F.struct((-x["mapq"]).alias("m"), (-cigar_length(x["cigar"])).alias("l"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda r: r["x"])


def dedup_pairs(pairs: DataFrame, read: str = "read_id", jitter: int = 50) -> DataFrame:
    """One row per read and pair of breakpoint bins."""
    keyed = pairs.withColumn("_l", F.floor(F.col("left_pos") / jitter)).withColumn("_r", F.floor(F.col("right_pos") / jitter))
    nth = F.row_number().over(W.partitionBy(read, "left_chr", "_l", "right_chr", "_r").orderBy("left_pos", "right_pos"))
    return keyed.withColumn("_n", nth).where("_n = 1").drop("_l", "_r", "_n")


def choose_gene(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One gene per point: exonic ones first, then the first by name."""
    return hits.groupBy(*keys).agg(F.min_by("gene", F.struct(~F.col("exonic"), F.col("gene"))).alias("gene"), F.max("exonic").alias("exonic"))


def label(gene: Column, symbols: Column | None = None) -> Column:
    """Name of a gene: its symbol if known, without an antisense suffix; clone and unnamed ids are intergenic."""
    name = F.regexp_replace(F.coalesce(symbols, gene) if symbols is not None else gene, r"-(AS|IT|OT|DT)\d*$", "")
    return F.when(name.isNull() | name.rlike(r"^(ENSG\d|RP\d+-)"), "intergenic").otherwise(name)


def aggregate(pairs: DataFrame, read: str = "read_id", bin_size: int = 1) -> DataFrame:
    """Candidates by unordered gene pair: the pair is ordered by name and positions go with it; support is distinct reads."""
    swap = F.col("left_gene") > F.col("right_gene")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    rows = pairs.where(F.col("left_gene") != F.col("right_gene")).select(read, pick("left_gene", "right_gene").alias("gene_a"), pick("right_gene", "left_gene").alias("gene_b"), pick("left_chr", "right_chr").alias("chr_a"), pick("right_chr", "left_chr").alias("chr_b"), pick("left_pos", "right_pos").alias("pos_a"), pick("right_pos", "left_pos").alias("pos_b"))
    return rows.groupBy("gene_a", "gene_b", "chr_a", "chr_b").agg(F.count_distinct(read).alias("support"), F.min("pos_a").alias("min_a"), F.max("pos_a").alias("max_a"), F.min("pos_b").alias("min_b"), F.max("pos_b").alias("max_b"))


def consensus(points: DataFrame, keys: list[str], w: int = 2000) -> DataFrame:
    """Densest w × w window of each key that begins at two of its positions' coordinates, and its weighted centre.

    Counts of cells of w/8 bound every window from below (cells inside it) and above (cells that it meets); both are sums along one
    side, then the other. Only points of cells whose upper bound reaches the key's best lower bound begin a window that is summed. They
    are dealt by tiles of w, each with the points of its four tiles (at most 2w × 2w different places), where all windows come from
    running sums along both sides: the work grows with the points, not with the pairs of them."""
    cell = max(1, w // 8)
    span = -(-w // cell)
    counted = points.groupBy(*keys, "pos_a", "pos_b").agg(F.count("*").alias("n"))
    counted = counted.withColumn("ca", F.floor(F.col("pos_a") / cell)).withColumn("cb", F.floor(F.col("pos_b") / cell))
    cells = counted.groupBy(*keys, "ca", "cb").agg(F.sum("n").alias("n"))

    def summed(df: DataFrame, side: str, reach: tuple[int, int], value: str, name: str) -> DataFrame:
        """For each cell, the sum over the cells from reach[0] to reach[1] further along a side."""
        back = F.explode(F.array(*[F.lit(k) for k in range(reach[0], reach[1] + 1)]))
        moved = df.select(*keys, "ca", "cb", value, back.alias("_k")).withColumn(side, F.col(side) - F.col("_k"))
        return moved.groupBy(*keys, "ca", "cb").agg(F.sum(value).alias(name))

    upper = summed(summed(cells, "ca", (0, span), "n", "u"), "cb", (0, span), "u", "upper")
    lower = summed(summed(cells, "ca", (1, span - 1), "n", "l"), "cb", (1, span - 1), "l", "lower") if span > 1 else cells.withColumn("lower", F.lit(0).cast("bigint"))
    own = cells.select(*keys, "ca", "cb").join(upper, [*keys, "ca", "cb"]).join(lower.select(*keys, "ca", "cb", "lower"), [*keys, "ca", "cb"], "left")
    floor = own.groupBy(*keys).agg(F.max(F.coalesce("lower", F.lit(0))).alias("_floor"))
    begin = own.join(floor, keys).where(F.col("upper") >= F.col("_floor")).select(*keys, "ca", "cb", F.lit(True).alias("_begins"))
    # Rows without a key have no window, as joins on the keys match none.
    marked = counted.join(begin, [*keys, "ca", "cb"], "left").withColumn("_begins", F.coalesce("_begins", F.lit(False)))
    tiles = marked.withColumn("ta", F.floor(F.col("pos_a") / w)).withColumn("tb", F.floor(F.col("pos_b") / w))
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    dealt = tiles.select(*keys, "pos_a", "pos_b", "n", F.explode(moves).alias("d"), "ta", "tb", "_begins").withColumn("ta", F.col("ta") - F.col("d.i")).withColumn("tb", F.col("tb") - F.col("d.j"))
    # A tile's own points (d = 0, 0) begin its windows.
    dealt = dealt.withColumn("_begins", F.col("_begins") & (F.col("d.i") == 0) & (F.col("d.j") == 0)).drop("d")
    wanted = dealt.where("_begins").select(*keys, "ta", "tb").distinct()
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keys)
    windows = dealt.join(wanted, [*keys, "ta", "tb"], "left_semi").groupBy(*keys, "ta", "tb").applyInPandas(lambda pdf: _densest(pdf, keys, w), f"{kinds}, a0 bigint, b0 bigint, reads bigint, sa bigint, sb bigint")
    best = windows.groupBy(*keys).agg(F.min_by(F.struct("reads", "sa", "sb"), F.struct(-F.col("reads"), "a0", "b0")).alias("w"))
    return best.select(*keys, F.col("w.reads").alias("window_reads"), F.expr("w.sa div w.reads").alias("consensus_a"), F.expr("w.sb div w.reads").alias("consensus_b"))


def _densest(pdf: pd.DataFrame, keys: list[str], w: int) -> pd.DataFrame:
    """The best window that begins at one of the rows that say so, of most reads, then of the least corner. The lines of one side enter
    and leave a sum over the other side's places, so that a line costs its places and its beginnings."""
    a, b, n, begins = (pdf[c].to_numpy() for c in ("pos_a", "pos_b", "n", "_begins"))
    ua, ia = np.unique(a, return_inverse=True)
    ub, ib = np.unique(b, return_inverse=True)
    order = np.lexsort((ib, ia))
    ia, ib, n, begins = ia[order], ib[order], n[order], begins[order].astype(bool)
    starts = np.searchsorted(ia, np.arange(len(ua) + 1))
    until_a, until_b = np.searchsorted(ua, ua + w), np.searchsorted(ub, ub + w)
    line, gone, best = np.zeros(len(ub), dtype=np.int64), 0, None
    upto = 0
    for k in range(len(ua)):
        rows = slice(starts[gone], starts[k])
        np.subtract.at(line, ib[rows], n[rows])
        rows = slice(starts[upto], starts[until_a[k]])
        np.add.at(line, ib[rows], n[rows])
        gone, upto = k, until_a[k]
        at = ib[starts[k] : starts[k + 1]][begins[starts[k] : starts[k + 1]]]
        if len(at):
            run = np.concatenate(([0], np.cumsum(line)))
            reads = run[until_b[at]] - run[at]
            top = int(reads.argmax())  # the first of equals: places are sorted
            if best is None or reads[top] > best[0]:
                best = (int(reads[top]), k, int(at[top]))
    reads, k, j = best
    inside = (ia >= k) & (ia < until_a[k]) & (ib >= j) & (ib < until_b[j])
    sums = [int((u[i[inside]] * n[inside]).sum()) for u, i in ((ua, ia), (ub, ib))]
    return pd.DataFrame([[*(pdf[c].iloc[0] for c in keys), int(ua[k]), int(ub[j]), reads, *sums]], columns=[*keys, "a0", "b0", "reads", "sa", "sb"])


def gene_frequency(candidates: DataFrame, most: int = 4, most_special: int = 2) -> DataFrame:
    """Flags candidates with a gene in more than `most` of them (ribosomal and histone genes: more than `most_special`)."""
    genes = candidates.select("gene_a", "gene_b").select(F.explode(F.array("gene_a", "gene_b")).alias("gene")).groupBy("gene").agg(F.count("*").alias("n"))
    special = F.col("gene").rlike(r"^(RP[LS]\d|MRP[LS]\d|HIST|H[1234][A-Z])")
    often = genes.where(F.col("n") > F.when(special, most_special).otherwise(most)).select("gene")
    a, b = often.withColumnRenamed("gene", "gene_a").withColumn("_fa", F.lit(True)), often.withColumnRenamed("gene", "gene_b").withColumn("_fb", F.lit(True))
    return candidates.join(a, "gene_a", "left").join(b, "gene_b", "left").withColumn("frequent", F.coalesce("_fa", "_fb", F.lit(False))).drop("_fa", "_fb")


def is_multicopy(gene: Column) -> Column:
    return gene.rlike(r"^(HLA-|IGH|IGK|IGL|TRA[VJC]|TRB[VJDC]|RP[LS]\d|HIST|MT-|MTRNR|OR\d)")


def is_mitochondrial(chrom: Column, gene: Column) -> Column:
    return chrom.isin("chrM", "chrMT", "MT", "M") | gene.startswith("MT-")


def validate(candidates: DataFrame, least_support: int = 2, max_intra: int | None = None) -> DataFrame:
    """Class, reasons and confidence of candidates (support, frequent, chromosomes, positions)."""
    same = F.col("chr_a") == F.col("chr_b")
    gap = F.abs(F.col("min_b") - F.col("max_a"))
    near = same & (gap <= max_intra) if max_intra is not None else F.lit(False)
    reasons = F.array_compact(F.array(
        F.when(F.col("support") < least_support, "low_support"), F.when(F.col("frequent"), "frequent_gene"), F.when(is_mitochondrial(F.col("chr_a"), F.col("gene_a")) | is_mitochondrial(F.col("chr_b"), F.col("gene_b")), "mitochondrial"),
        F.when((F.col("gene_a") == "intergenic") | (F.col("gene_b") == "intergenic"), "intergenic"), F.when(is_multicopy(F.col("gene_a")) & is_multicopy(F.col("gene_b")), "multicopy"),
    ))
    kind = F.when(near, "cis-SAGe").when(same, "intrachromosomal").otherwise("interchromosomal")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + F.least(F.col("support"), F.lit(10)) * 0.05 - F.size(reasons) * 0.3))
    return candidates.withColumn("reasons", F.array_join(reasons, ",")).withColumn("class", kind).withColumn("confidence", F.round(score, 3)).withColumn("valid", F.size(reasons) == 0)


def merge_identical(candidates: DataFrame, gap: int = 100) -> DataFrame:
    """Candidates with the same genes whose breakpoints lie within `gap` on both sides, directly or through others on each side in
    turn, become one; support adds up. Neighbours are found by a sweep over one side, then over the other, so no grid cuts them apart."""
    keys = ["gene_a", "gene_b", "chr_a", "chr_b"]
    rows = candidates
    for side, other, name in (("consensus_a", "consensus_b", "_ga"), ("consensus_b", "consensus_a", "_gb")):
        group = keys if name == "_ga" else [*keys, "_ga"]
        order = W.partitionBy(*group).orderBy(side, other)
        rows = rows.withColumn("_new", F.when(F.col(side) - F.lag(side).over(order) <= gap, 0).otherwise(1)).withColumn(name, F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    return rows.groupBy(*keys, "_ga", "_gb").agg(F.sum("support").alias("support"), F.max_by(F.struct("consensus_a", "consensus_b"), F.struct("support", -F.col("consensus_a"), -F.col("consensus_b"))).alias("at"), F.count("*").alias("merged")).drop("_ga", "_gb")


def agreement(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of unordered gene pairs."""
    key = lambda df: df.select(F.least("gene_a", "gene_b").alias("a"), F.greatest("gene_a", "gene_b").alias("b")).distinct()
    both = key(predicted).withColumn("p", F.lit(1)).join(key(truth).withColumn("t", F.lit(1)), ["a", "b"], "full")
    n = both.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


# ---------------------------------------------------------------- reads, gates and the validation cascade

# Genes whose fusions are known drivers, and name prefixes of families that produce artifacts.
DRIVERS = ("BCR", "ABL1", "RUNX1", "RUNX1T1", "PML", "RARA", "ETV6", "NUP98", "NUP214", "KMT2A", "MLLT3", "EWSR1", "ERG", "FGFR1", "RET", "ROS1", "ALK", "TMPRSS2", "FLI1", "MYH11", "CBFB")
ARTIFACT_PREFIXES = ("RPL", "RPS", "MRPL", "MRPS", "H1-", "H2A", "H2B", "H3-", "H4-", "HIST1", "HIST2", "HIST3", "HLA-", "MICA", "MICB", "KRT", "OR", "ZNF", "DEFA", "DEFB", "IGH", "IGK", "IGL", "TRAV", "TRBV", "TRGV", "TRDV", "MUC", "AMY", "CYP")


def fusion_reads(alignments: DataFrame, least_length: int = 50, least_mapq: int = 10) -> DataFrame:
    """Primary alignments (cigar, mapq, is_secondary, is_supplementary) of enough aligned bases and quality."""
    keep = (cigar_length(F.col("cigar")) >= least_length) & (F.col("mapq") >= least_mapq)
    return alignments.where(keep & ~F.coalesce("is_secondary", F.lit(False)) & ~F.coalesce("is_supplementary", F.lit(False)))


def is_allowed_biotype(biotype: Column) -> Column:
    """A biotype that a fusion's gene may have; an unknown one is no reason against it."""
    return biotype.isNull() | biotype.isin(*BIOTYPES)


def is_artifact_family(gene: Column) -> Column:
    return F.coalesce(F.upper(gene).rlike("^(" + "|".join(ARTIFACT_PREFIXES) + ")"), F.lit(False))


def gate(points: DataFrame, keys: list[str], read: str = "read_id", least: int = 1, w: int = 2000) -> DataFrame:
    """Candidates (keys, support, window_reads, consensus_a, consensus_b) that enough reads support and whose breakpoints agree on a
    window; points: keys, read, pos_a, pos_b."""
    support = points.groupBy(*keys).agg(F.count_distinct(read).alias("support")).where(F.col("support") >= least)
    return support.join(consensus(points.where("pos_a is not null and pos_b is not null"), keys, w), keys)


def with_genes(candidates: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds symbols and biotypes (null if unknown) of gene_a and gene_b. genes: gene, symbol, biotype."""
    info = genes.groupBy("gene").agg(F.min("symbol").alias("symbol"), F.min("biotype").alias("biotype"))
    out = candidates
    for side in ("a", "b"):
        named = info.select(F.col("gene").alias(f"gene_{side}"), F.col("symbol").alias(f"_s{side}"), F.col("biotype").alias(f"biotype_{side}"))
        out = out.join(named, f"gene_{side}", "left").withColumn(f"symbol_{side}", label(F.col(f"gene_{side}"), F.coalesce(f"_s{side}", f"gene_{side}"))).drop(f"_s{side}")
    return out


def confidence(support: Column, gene_a: Column, gene_b: Column, reconstructed: Column, hits: Column, best_mapq: Column) -> Column:
    """Support up to ten reads, a bonus for a reconstructed junction and its realignments, a malus for artifact families, a bonus for drivers."""
    own = F.least(support, F.lit(10)) / 10.0
    found = F.when(reconstructed, 0.2).otherwise(0.0) + F.least(hits, F.lit(3)) * 0.1 + F.least(best_mapq, F.lit(30)) / 300.0
    prior = F.when(is_artifact_family(gene_a) | is_artifact_family(gene_b), -0.3).otherwise(0.0) + F.when(gene_a.isin(*DRIVERS) | gene_b.isin(*DRIVERS), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), own + found + prior))


def cascade(candidates: DataFrame, least_support: int = 2, max_intra: int | None = None, cis_allowed: bool = True, least_confidence: float = 0.3, low_support: int = 2, most: int = 4, most_special: int = 2) -> DataFrame:
    """Class, validity, reasons and confidence of candidates: gene_a/b, symbol_a/b, biotype_a/b, chr_a/b, consensus_a/b, support and, if
    there are any, reconstructed, hits and best_mapq of a realignment.

    Filters over all candidates come first (biotypes, pairs of artifact families, genes in many candidates); what they reject is judged
    no further. The others pass gates in order: support, breakpoint, one gene, names, mitochondria, policy, confidence."""
    optional = {"reconstructed": F.lit(False), "hits": F.lit(0), "best_mapq": F.lit(0)}
    rows = gene_frequency(candidates, most, most_special)
    for c, default in optional.items():
        if c not in rows.columns:
            rows = rows.withColumn(c, default)
    a, b = F.col("symbol_a"), F.col("symbol_b")
    unnamed = F.col("gene_a").isNull() | F.col("gene_b").isNull() | (a == "intergenic") | (b == "intergenic")
    before = F.when(~is_allowed_biotype(F.col("biotype_a")) | ~is_allowed_biotype(F.col("biotype_b")), "non-coding partner").when(is_artifact_family(a) & is_artifact_family(b), "multicopy artifact pair").when(F.col("frequent"), "frequent gene")
    near = (F.col("chr_a") == F.col("chr_b")) & (F.abs(F.col("consensus_b") - F.col("consensus_a")) <= max_intra) if max_intra is not None else F.lit(False)
    few, lost = F.col("support") < least_support, F.col("consensus_a").isNull() | F.col("consensus_b").isNull()
    kind = F.when(few | lost, "canonical").when(unnamed, "intergenic").when(a == b, "intragenic").when(near, "cis-SAGe").otherwise("canonical")
    rows = rows.withColumn("_before", before).withColumn("class", kind)
    rows = rows.withColumn("confidence", F.round(confidence(F.col("support"), a, b, F.col("reconstructed"), F.col("hits"), F.col("best_mapq")), 3))
    mito = is_mitochondrial(F.col("chr_a"), F.coalesce(a, F.lit(""))) | is_mitochondrial(F.col("chr_b"), F.coalesce(b, F.lit("")))
    same, hard = F.col("class") == "intragenic", F.col("class") == "cis-SAGe"
    sound = ~few & ~lost & ~same & ~unnamed
    gates = F.array_compact(F.array(
        F.when(few, "low support"), F.when(~few & lost, "no stable breakpoint"), F.when(~few & ~lost & same, "one locus"), F.when(~few & ~lost & unnamed, "missing gene name"), F.when(sound & mito, "mitochondrial"),
        F.when(hard & F.lit(not cis_allowed), "cis-SAGe disallowed"), F.when(sound & ~mito & (F.col("confidence") < least_confidence) & (F.col("support") < low_support), "low confidence"),
    ))
    rows = rows.withColumn("reasons", F.when(F.col("_before").isNotNull(), F.array("_before")).otherwise(gates))
    return rows.withColumn("valid", F.size("reasons") == 0).drop("_before")


def fusion_table(judged: DataFrame, least_confidence: float = 0.3, classes: tuple[str, ...] = ("canonical", "cis-SAGe"), only_valid: bool = False) -> DataFrame:
    """The report's columns of judged candidates, best supported first when it is written in order of SupportingReads."""
    keep = (F.col("confidence") >= least_confidence) & F.col("class").isin(*classes) & F.col("consensus_a").isNotNull() & (F.col("symbol_a") != F.col("symbol_b"))
    rows = judged.where(keep & F.col("valid") if only_valid else keep)
    text = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    return rows.select(
        F.col("symbol_a").alias("LeftGene"), text("biotype_a", "unknown").alias("LeftBiotype"), F.col("chr_a").alias("LeftChromosome"), F.col("consensus_a").alias("LeftBreakpoint"),
        F.col("symbol_b").alias("RightGene"), text("biotype_b", "unknown").alias("RightBiotype"), F.col("chr_b").alias("RightChromosome"), F.col("consensus_b").alias("RightBreakpoint"),
        F.col("support").alias("SupportingReads"), F.concat_ws("-", "symbol_a", "symbol_b").alias("FusionName"), F.col("class").alias("Class"), F.col("valid").alias("Valid"), F.format_string("%.3f", "confidence").alias("Confidence"), F.array_join("reasons", ";").alias("Reasons"),
    )
