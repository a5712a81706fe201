"""Work on single alignments: tails, splice motifs, corrections of junctions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import intervals as I
from ..params import MATCHING, Matching

# Canonical pairs of intron ends on either strand, as read on the forward strand.
FORWARD = (("GT", "AG"), ("GC", "AG"), ("AT", "AC"))
REVERSE = (("CT", "AC"), ("CT", "GC"), ("GT", "AT"))


def tail_start(seq: str | None, window: int, share: float, base: str = "A") -> int:
    """Offset of the first window of a tail: mostly `base`, moved to its first run of two; -1 if there is none."""
    if not seq or len(seq) < window:
        return -1
    need, n = int(window * share), seq[:window].count(base)
    for i in range(len(seq) - window + 1):
        if i:
            n += (seq[i + window - 1] == base) - (seq[i - 1] == base)
        if n >= need:
            return i + max(0, seq[i : i + window].find(base * 2))
    return -1


def find_tails(alignments: DataFrame, p: Matching = MATCHING["default"]) -> DataFrame:
    """Adds polya (position behind the last base before an A tail) and polyt (before the first base behind a T tail), null if there is
    none. The sequence around each clip is cut out in the JVM; the window scan runs over Arrow batches."""
    w, share = p.polya_window, p.polya_fraction

    @F.pandas_udf(LongType())
    def right(tail: pd.Series) -> pd.Series:
        return tail.map(lambda s: tail_start(s, w, share))

    @F.pandas_udf(LongType())
    def left(head: pd.Series) -> pd.Series:
        return head.map(lambda s: tail_start(s[::-1], w, share, "T") if s else -1)

    clip = lambda pattern: F.coalesce(F.regexp_extract("cigar", pattern, 1).try_cast("int"), F.lit(0))
    rows = alignments.withColumn("_r", clip(r"(\d+)S(?:\d+H)?$")).withColumn("_l", clip(r"^(?:\d+H)?(\d+)S"))
    around = 2 * w
    tail = F.expr(f"substring(seq, greatest(1, length(seq) - _r - {around} + 1), _r + {around})")
    head = F.expr(f"substring(seq, 1, _l + {around})")
    rows = rows.withColumn("_a", right(tail)).withColumn("_t", left(head))
    inner = F.least(F.length("seq") - F.col("_r"), F.lit(around))
    polya = F.when(F.col("_a") >= 0, F.element_at("blocks", -1)["e"] - F.greatest(inner - F.col("_a"), F.lit(0)))
    inner_t = F.least(F.length("seq") - F.col("_l"), F.lit(around))
    polyt = F.when(F.col("_t") >= 0, F.element_at("blocks", 1)["s"] + F.greatest(inner_t - F.col("_t"), F.lit(0)))
    return rows.withColumn("polya", polya).withColumn("polyt", polyt).drop("_r", "_l", "_a", "_t")


def trim_tail_exons(blocks: Column, polya: Column, polyt: Column) -> Column:
    """Blocks without terminal ones that lie mostly in a tail, at least one stays."""
    half = lambda b: (b["s"] + b["e"]) / 2
    kept = F.filter(blocks, lambda b: F.coalesce(half(b) <= polya, F.lit(True)) & F.coalesce(half(b) >= polyt, F.lit(True)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(blocks, 1, 1))


def artificial_tail(rows: DataFrame, mode: str = "stranded") -> DataFrame:
    """Tails for trimmed data: the end on the read's strand, or both ends in mode all."""
    plus, minus = F.col("strand") == "+", F.col("strand") == "-"
    if mode == "all":
        plus = minus = F.lit(True)
    return rows.withColumn("polya", F.coalesce("polya", F.when(plus, F.element_at("blocks", -1)["e"]))).withColumn("polyt", F.coalesce("polyt", F.when(minus, F.element_at("blocks", 1)["s"])))


def motif_counts(introns: Column, seq: Column, start: Column) -> tuple[Column, Column]:
    """Introns with forward and with reverse canonical ends; seq begins at position start."""
    at = lambda pos: F.substr(seq, (pos - start + 1).cast("int"), F.lit(2))
    known = lambda i, pairs: F.concat(at(i["s"]), F.lit("-"), at(i["e"] - 1)).isin(*[f"{a}-{b}" for a, b in pairs])
    count = lambda pairs: F.size(F.filter(introns, lambda i: known(i, pairs)))
    return count(FORWARD), count(REVERSE)


def splice_strand(introns: Column, seq: Column, start: Column, polya: Column | None = None, polyt: Column | None = None) -> Column:
    """Strand by majority of splice motifs; on a tie the tail decides, else a dot."""
    forward, reverse = motif_counts(introns, F.upper(seq), start)
    tie = F.when(polya.isNotNull() & polyt.isNull(), "+").when(polyt.isNotNull() & polya.isNull(), "-").otherwise(".") if polya is not None else F.lit(".")
    return F.when(forward > reverse, "+").when(reverse > forward, "-").otherwise(tie)


def all_canonical(introns: Column, seq: Column, start: Column, strand: Column) -> Column:
    forward, reverse = motif_counts(introns, F.upper(seq), start)
    return F.when(F.size(introns) == 0, None).otherwise(F.when(strand == "+", forward).otherwise(reverse) == F.size(introns))


def downstream_a_share(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, (F.length(seq) - F.length(F.regexp_replace(seq, "[Aa]", ""))) / F.length(seq))


def assignment_strand(kind: Column, isoform_strand: Column, n_blocks: Column, tail_strand: Column, motif_strand: Column) -> Column:
    """Strand of a read: that of its isoform if unique, of its tail if unspliced, else of its splice motifs."""
    return F.when(kind.isin("unique", "unique_minor_difference"), isoform_strand).when(n_blocks == 1, F.coalesce(tail_strand, F.lit("."))).otherwise(motif_strand)


def correct_junctions(introns: Column, reference: Column, delta: int) -> Column:
    """Read introns replaced by the nearest reference intron within delta at both ends."""

    def best(i: Column) -> Column:
        near = F.filter(reference, lambda r: I.equal_ranges(i, r, delta))
        ranked = F.transform(near, lambda r: F.struct((F.abs(r["s"] - i["s"]) + F.abs(r["e"] - i["e"])).alias("d"), r.alias("r")))
        return F.coalesce(F.array_min(ranked)["r"], i)

    return F.transform(introns, best)


def correct_by_short_reads(introns: Column, short: Column, shift: int = 4, middle: int = 50, sides: int = 25) -> Column:
    """Introns snapped to a short-read intron that differs by exactly `shift` at one end, or split in two around a short exon that was skipped."""

    def one(i: Column) -> Column:
        exact = F.exists(short, lambda x: (x["s"] == i["s"]) & (x["e"] == i["e"]))
        near = F.filter(short, lambda x: ((x["s"] == i["s"]) & (F.abs(x["e"] - i["e"]) == shift)) | ((x["e"] == i["e"]) & (F.abs(x["s"] - i["s"]) == shift)))
        firsts = F.filter(short, lambda x: (F.abs(x["s"] - i["s"]) <= sides) & (x["e"] < i["e"]))
        pairs = F.flatten(F.transform(firsts, lambda a: F.transform(F.filter(short, lambda b: (F.abs(b["e"] - i["e"]) <= sides) & (b["s"] > a["e"] + 1) & (b["s"] - a["e"] - 1 <= middle)), lambda b: F.array(I.iv(a["s"], a["e"]), I.iv(b["s"], b["e"])))))
        same = F.array(I.iv(i["s"], i["e"]))
        return F.when(exact, same).when(F.size(near) > 0, F.transform(F.slice(F.array_sort(near), 1, 1), lambda x: I.iv(x["s"], x["e"]))).when(F.size(pairs) > 0, F.array_min(pairs)).otherwise(same)

    return F.flatten(F.transform(introns, one))


def cage_hits(reads: DataFrame, peaks: DataFrame, window: int = 5) -> DataFrame:
    """Reads (aln_id, chr, strand, five_prime) with the CAGE peaks of their strand that lie about their 5' end."""
    from .regions import interval_join

    a = reads.select("aln_id", "chr", F.col("strand").alias("read_strand"), (F.col("five_prime") - window).alias("_ls"), (F.col("five_prime") + window).alias("_le"))
    b = peaks.select("chr", F.col("strand").alias("peak_strand"), F.col("s").alias("rs"), F.col("e").alias("re"))
    return interval_join(a, b, "chr", "_ls", "_le").where("read_strand = peak_strand").select("aln_id", "rs", "re")
