"""Hand-made cases of operators that SQL cannot express, and of formats."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from readloom.functions import intervals as I
from readloom.operators import alignments as A
from readloom.operators import classify as K
from readloom.operators import discovery as G
from readloom.operators import fusion as X
from readloom.operators import molecules as U
from readloom.operators import regions as R
from readloom.operators import terminal as T
from readloom.params import DISCOVERY, MATCHING, with_delta
from readloom.sources import readers, sinks

P = MATCHING["default"]


IV = "struct<s:bigint,e:bigint>"


def gaps(blocks):
    return [(x[1] + 1, y[0] - 1) for x, y in zip(blocks, blocks[1:], strict=False)]


def all_events(spark, rows):
    """Events of (read blocks, isoform blocks, known introns), a list for each row."""
    data = [(k, gaps(r), (r[0][0], r[-1][1]), gaps(i), (i[0][0], i[-1][1]), list(known)) for k, (r, i, known) in enumerate(rows)]
    df = spark.createDataFrame(data, f"id int, introns array<{IV}>, span {IV}, tx_introns array<{IV}>, tx_span {IV}, known array<{IV}>")
    return [[e.event for e in r.events] for r in sorted(K.with_events(df).collect(), key=lambda r: r.id)]


ISO = [(1000, 1200), (2000, 2200), (3000, 3300), (4000, 4300)]


CASES = [
        (ISO, (), ["fsm"]),
        ([(1003, 1198), (2002, 2200), (3000, 3300), (4000, 4295)], (), ["fsm"]),
        ([(2050, 2200), (3000, 3300), (4000, 4300)], (), ["ism_left"]),
        ([(1000, 1200), (2000, 2150)], (), ["ism_right"]),
        ([(2050, 2200), (3000, 3250)], (), ["ism_internal"]),
        ([(1000, 1200), (2000, 3300), (4000, 4300)], (), ["intron_retention"]),
        ([(1000, 1200), (3000, 3300), (4000, 4300)], (), ["exon_skipping_novel"]),
        ([(1000, 1200), (3000, 3300), (4000, 4300)], ((1201, 2999),), ["exon_skipping_known"]),
        ([(1000, 1200), (2000, 2240), (3000, 3300), (4000, 4300)], (), ["alt_left_site_novel"]),
        ([(1000, 1200), (2000, 2200), (2900, 3300), (4000, 4300)], (), ["alt_right_site_novel"]),
        ([(1000, 1200), (2000, 2200), (3000, 3100), (3201, 3300), (4000, 4300)], (), ["extra_intron_novel"]),
        ([(1000, 1200), (2000, 2200), (2500, 2600), (3000, 3300), (4000, 4300)], (), ["exon_gain_novel"]),
        ([(1000, 1210), (2010, 2200), (3000, 3300), (4000, 4300)], (), ["intron_shift"]),
        ([(500, 700), (1000, 1200), (2000, 2200), (3000, 3300), (4000, 4300)], (), ["extra_intron_flanking_left"]),
        ([(680, 700), (1000, 1200), (2000, 2200), (3000, 3300), (4000, 4300)], (), ["fake_terminal_exon_left"]),
        ([(1050, 1150)], (), ["mono_exonic"]),
        ([(1050, 2100)], (), ["unspliced_intron_retention"]),
        ([(1100, 1400)], (), ["incomplete_intron_retention_right"]),
]


def test_junction_events(spark):
    found = all_events(spark, [(read, ISO, known) for read, known, _ in CASES])
    for (read, known, expected), got in zip(CASES, found, strict=True):
        assert [e for e in got if not e.startswith("terminal_site")] == expected, (read, known)


def test_mono_exon_and_ends(spark):
    near, far = all_events(spark, [([(103, 480)], [(100, 500)], ()), ([(20, 530)], [(100, 500)], ())])
    assert near == ["mono_exon_match", "terminal_site_match_left_precise", "terminal_site_match_right"]
    assert far == ["mono_exon_match", "major_exon_elongation_left", "terminal_site_match_right", "exon_elongation_right"]


@pytest.mark.parametrize(
    ("blocks", "tail", "inner", "events", "expected"),
    [
        ([(1000, 1200), (2000, 2290)], 2291, None, ["fsm", "exon_elongation_right"], ["fsm", "correct_polya_site_right"]),
        ([(1000, 1200), (2000, 2700)], 2701, None, ["fsm", "major_exon_elongation_right"], ["fsm", "alternative_polya_site_right"]),
        ([(1000, 1200), (2000, 2100)], 2101, None, ["fsm"], ["fsm", "alternative_polya_site_right"]),
        ([(1000, 1260)], None, 1255, ["incomplete_intron_retention_right"], ["incomplete_intron_retention_right", "internal_polya_right"]),
        ([(1000, 1200), (2000, 2300), (2900, 2920)], 2921, None, ["fake_terminal_exon_right"], ["fake_terminal_exon_right", "correct_polya_site_right"]),
        ([(1000, 1200), (2000, 2300)], None, None, ["fsm"], ["fsm"]),
    ],
)
def test_tails(spark, blocks, tail, inner, events, expected):
    """The + case and its mirror image on -."""
    isoform, at = [(1000, 1200), (2000, 2300)], 10_000
    e = lambda *n: [(x, -1, -1, -1, -1, 0) for x in n]
    flip = lambda bs: [(at - b, at - a) for a, b in bs][::-1]
    swap = lambda names: [n.replace("right", "left") for n in names]
    mirror = lambda x: None if x is None else at - x
    rows = [(1, "+", blocks, isoform, tail, inner, e(*events)), (2, "-", flip(blocks), flip(isoform), mirror(tail), mirror(inner), e(*swap(events)))]
    df = spark.createDataFrame(rows, f"id int, strand string, blocks array<{IV}>, exons array<{IV}>, tail bigint, inner_tail bigint, events {K.EVENT_TYPE}")
    got = {r.id: [x.event for x in r.events] for r in K.verify_tails(df).collect()}
    assert got[1] == expected and got[2] == swap(expected)


def test_missed_terminal_exon(spark):
    rows = [(1, "+", [(1000, 1200)], [(1000, 1200), (2000, 2030)], 1225, None, [("ism_right", -1, -1, -1, -1, 0)])]
    df = spark.createDataFrame(rows, f"id int, strand string, blocks array<{IV}>, exons array<{IV}>, tail bigint, inner_tail bigint, events {K.EVENT_TYPE}")
    assert [x.event for x in K.verify_tails(df).head().events] == ["ism_right", "terminal_exon_misalignment_right", "correct_polya_site_right"]


def test_names_by_strand_and_matching(spark):
    want = {("exon_elongation_left", "+"): "exon_elongation_5", ("exon_elongation_left", "-"): "exon_elongation_3", ("terminal_site_match_right_precise", "-"): "tss_match_precise", ("terminal_site_match_left", "."): "terminal_position_match",
            ("alt_left_site_novel", "+"): "alt_donor_site_novel", ("alt_left_site_known", "-"): "alt_acceptor_site_known", ("fsm", "-"): "fsm", ("ism_left", "."): "ism", ("ism_internal", "+"): "ism_internal", ("extra_intron_flanking_right", "+"): "extra_intron_3", ("correct_polya_site_right", "+"): "correct_polya_site_right"}
    rows = spark.createDataFrame(list(want), "e string, s string")
    assert {(r.e, r.s): r.n for r in rows.select("e", "s", K.strand_name(F.col("e"), F.col("s")).alias("n")).collect()} == want
    kinds = spark.createDataFrame([("unique", ["intron_retention"]), ("unique_minor_difference", ["fsm", "intron_shift"]), ("unique_minor_difference", ["fake_terminal_exon_left"]), ("ambiguous", ["fsm"])], "k string, n array<string>")
    found = kinds.select(K.is_matching(F.col("k"), F.transform("n", lambda x: F.struct(x.alias("event")))).alias("m"))
    assert [r.m for r in found.collect()] == [True, True, False, False]


def test_assignment_types(spark):
    e = lambda *n: [{"event": x, "iso_lo": -1, "iso_hi": -1, "read_lo": -1, "read_hi": -1, "info": 175 if "elongation" in x else 0} for x in n]
    rows = [("a", 1, 1, e("fsm")), ("b", 1, 1, e("fsm")), ("b", 2, 1, e("ism_left")), ("c", 1, 1, e("intron_shift", "fsm")), ("d", 1, 1, e("exon_skipping_novel")), ("d", 2, 1, e("exon_skipping_novel", "intron_retention")), ("f", 1, 1, e("major_exon_elongation_left")), ("g", 1, 1, e("intron_retention")), ("g", 2, 2, e("intron_retention"))]
    df = spark.createDataFrame(rows, f"aln_id string, tx_id long, gene_id long, events {K.EVENT_TYPE}")
    got = {(r.aln_id, r.tx_id): r for r in K.assign(df).collect()}
    assert {k: r.assignment_type for k, r in got.items()} == {("a", 1): "unique", ("b", 1): "ambiguous", ("b", 2): "ambiguous", ("c", 1): "unique_minor_difference", ("d", 1): "inconsistent", ("f", 1): "inconsistent_non_intronic", ("g", 1): "inconsistent_ambiguous", ("g", 2): "inconsistent_ambiguous"}
    assert got["b", 1].gene_assignment_type == "unique" and got["g", 1].gene_assignment_type == "inconsistent_ambiguous"
    assert got["f", 1].penalty == 0.35 and got["d", 1]["class"] == "novel_not_in_catalog" and got["f", 1]["class"] == "novel_in_catalog"


def test_cigar_blocks(spark):
    rows = [("10S100M", 101, [(101, 200)]), ("50M100N20M5D30M", 1, [(1, 50), (151, 205)]), ("20M10I20M", 11, [(11, 50)]), ("30M50N10D50N40M3S", 1, [(1, 30), (141, 180)]), ("*", 5, []), ("5=3X2=", 7, [(7, 16)])]
    df = spark.createDataFrame([(c, p) for c, p, _ in rows], "cigar string, pos long")
    got = [[(b.s, b.e) for b in r.b] for r in df.select(readers.cigar_blocks(F.col("pos"), F.col("cigar")).alias("b")).collect()]
    assert got == [w for *_, w in rows]


def test_gtf_fasta_bed_sam(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#c\nchr1\tx\tgene\t1\t90\t.\t+\t.\tgene_id "G1"; gene_name "N 1"; tag "a"; tag "b";\nchr1\tx\texon\t1\t50\t.\t+\t.\tgene_id "G1"; transcript_id "T1";\nbad line\nchr1\tx\tCDS\t70\t80\t.\t+\t0\tgene_id "G1"; transcript_id "T1";\nchr1\tx\texon\t60\t90\t.\t+\t.\tgene_id "G1"; transcript_id "T1";\n')
    gtf = readers.read_gtf(spark, str(tmp_path / "a.gtf"))
    assert gtf.count() == 4 and gtf.where("feature = 'gene'").head().attributes["tag"] == ["a", "b"]
    assert sorted((r.s, r.e) for r in readers.exons_of(gtf).collect()) == [(1, 50), (60, 90)]
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(1000))
    (tmp_path / "g.fa").write_text(">chr1 text\n" + "\n".join(seq[k : k + 60] for k in range(0, 1000, 60)) + "\n>chr2\nACGT\n")
    tiles = readers.read_fasta(spark, str(tmp_path / "g.fa"), 64)
    spots = spark.createDataFrame([("chr1", 5, 20), ("chr1", 60, 300), ("chr2", 1, 4)], "chr string, s long, e long")
    assert {(r.chr, r.s): r.seq for r in readers.fetch(spots, tiles, 64).collect()} == {("chr1", 5): seq[4:20], ("chr1", 60): seq[59:300], ("chr2", 1): "ACGT"}
    (tmp_path / "p.bed").write_text("chr1\t9\t20\tn\t5\t+\n")
    assert readers.read_bed(spark, str(tmp_path / "p.bed")).head()[:3] == ("chr1", 10, 20)
    (tmp_path / "r.sam").write_text("@HD\nr1\t16\tchr1\t11\t60\t5S20M\t*\t0\t0\tACGT\t*\tCB:Z:AAC-1\tUB:Z:TT\nr2\t2304\tchr1\t1\t0\t9M\t*\t0\t0\tA\t*\n")
    sam = readers.barcode_tags(readers.read_sam(spark, str(tmp_path / "r.sam")))
    a, b = sorted(sam.collect(), key=lambda r: r.read_id)
    assert (a.aligned_strand, a.barcode, a.umi, a.is_secondary) == ("-", "AAC", "TT", False) and b.is_secondary and b.is_supplementary and b.barcode is None
    (tmp_path / "q.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\n@@\n")
    assert sorted((r.read_id, r.seq, r.quality) for r in readers.read_fastq(spark, str(tmp_path / "q.fq")).collect()) == [("r1", "ACGT", "IIII"), ("r2", "GG", "@@")]


def test_molecule_definition_and_samples():
    parts = readers.parse_molecule("R1:Barcode:UMI:PolyT:cDNA\nR1 CONST CTACACGACG\nBarcode VAR_FILE list.tsv 16\nUMI VAR_ANY 12\n")
    assert [p["name"] for p in parts] == ["R1", "Barcode", "UMI", "PolyT", "cDNA"] and parts[1]["length"] == 16 and parts[0]["seq"] == "CTACACGACG"
    with pytest.raises(ValueError, match="undefined"):
        readers.parse_molecule("A:B\nA CONST AC\n")
    assert readers.parse_samples('[{"data format": "fastq"}, {"name": "s1", "long read files": ["a", "b"]}]') == [{"name": "s1", "long read files": ["a", "b"]}]
    assert readers.parse_samples("- data format: fastq\n- name: s1\n  long read files:\n    - a.fq\n    - b.fq\n")[0]["long read files"] == ["a.fq", "b.fq"]


def test_sinks(spark, tmp_path):
    tx = spark.createDataFrame([("t1", "g1", "chr1", "+", [(1, 50), (101, 150)])], f"tx_id string, gene_id string, chr string, strand string, exons array<{I.BLOCK}>")
    sinks.write_gtf(tx, str(tmp_path / "gtf"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "gtf")).collect()]
    assert [x.split("\t")[2] for x in lines] == ["gene", "transcript", "exon", "exon"]
    bed = sinks.bed12(tx, "tx_id", "exons").head()
    assert (bed.start, bed.end, bed.n_blocks, bed.sizes, bed.offsets) == (0, 150, 2, "50,50", "0,100")
    counts = spark.createDataFrame([("g", 1.5)], "feature_id string, count double")
    assert {r.feature_id: r["count"] for r in sinks.counts_table(counts, 2, 3, 4).collect()} == {"g": "1.50", "__ambiguous": "2", "__no_feature": "3", "__not_aligned": "4"}
    other = spark.createDataFrame([("h", 2.0), ("__ambiguous", 9.0)], "feature_id string, count double")
    assert {r[0]: (r.a, r.b) for r in sinks.combine_samples({"a": counts, "b": other}).collect()} == {"g": (1.5, 0.0), "h": (0.0, 2.0)}


def test_tails_and_strand(spark):
    body = "".join(random.Random(2).choice("CGT") for _ in range(60))
    rows = [("a", "60M20S", body + "A" * 20, [(101, 160)]), ("b", "20S60M", "T" * 20 + body.replace("T", "C"), [(101, 160)]), ("c", "60M", body, [(101, 160)])]
    df = spark.createDataFrame(rows, f"id string, cigar string, seq string, blocks array<{I.BLOCK}>")
    got = {r.id: (r.polya, r.polyt) for r in A.find_tails(df).collect()}
    assert got["a"][0] is not None and abs(got["a"][0] - 160) <= 4 and got["b"][1] is not None and abs(got["b"][1] - 101) <= 4 and got["c"][0] is None
    seq = spark.createDataFrame([("CCGTAAAAAGCC", [(3, 10)]), ("CCCTAAAAACCC", [(3, 10)]), ("CCGTAAAAAGCC", [])], f"seq string, introns array<{I.BLOCK}>")
    assert [r[0] for r in seq.select(A.splice_strand(F.col("introns"), F.col("seq"), F.lit(1))).collect()] == ["+", "-", "."]


def test_junction_correction(spark):
    df = spark.createDataFrame([([(100, 200), (300, 403), (500, 700)], [(102, 199), (300, 399), (500, 560), (591, 705)])], f"i array<{I.BLOCK}>, r array<{I.BLOCK}>")
    got = df.select(A.correct_junctions(F.col("i"), F.col("r"), 6).alias("a"), A.correct_by_short_reads(F.col("i"), F.col("r")).alias("b")).head()
    assert [(x.s, x.e) for x in got.a] == [(102, 199), (300, 399), (500, 700)]
    assert [(x.s, x.e) for x in got.b] == [(100, 200), (300, 399), (500, 560), (591, 705)]


def test_levenshtein_and_clusters():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rnd = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rnd.choice("AC") for _ in range(rnd.randint(0, 9))) for _ in range(2))
        assert U.levenshtein(a, b, 3) == min(4, full(a, b))
    got = U.cluster_umis({"AAAAAAAA": 5, "AAAAAAAT": 1, "CCCCCCCC": 2, "CCCCGGGG": 2}, 2, 8)
    assert got == {"AAAAAAAA": "AAAAAAAA", "AAAAAAAT": "AAAAAAAA", "CCCCGGGG": "CCCCGGGG", "CCCCCCCC": "CCCCCCCC"}


@pytest.mark.parametrize("protocol", list(U.LAYOUTS))
def test_barcode_calling(spark, protocol):
    rnd = random.Random(7)
    layout = U.LAYOUTS[protocol]
    dna = lambda n: "".join(rnd.choice("ACG") for _ in range(n))
    white = sorted({dna(layout["barcode"]) for _ in range(40)})
    rows, want = [], {}
    for k in range(20):
        barcode, umi = rnd.choice(white), dna(layout["umi"])
        middle = barcode + umi if not layout["linker"] else barcode + layout["linker"] + umi if layout.get("linker_after") else barcode[: layout["split"]] + layout["linker"] + barcode[layout["split"] :] + umi
        seq = dna(8) + layout["primer"] + middle + "T" * 30 + dna(120)
        if k % 2:
            seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        rows.append((f"r{k}", seq))
        want[f"r{k}"] = (barcode, umi, "-" if k % 2 else "+")
    rows += [("none", dna(200)), ("null", None)]
    reads = spark.createDataFrame(rows, "read_id string, seq string")
    calls = U.call_barcodes(reads, spark.createDataFrame([(w,) for w in white], "barcode string"), protocol)
    got = {r.read_id: (r.barcode, r.umi, r.strand) for r in calls.collect()}
    assert sum(got[k] == v for k, v in want.items()) >= 18 and got["none"][0] is None and got["null"][0] is None
    assert U.caller_stats(calls).head().reads == 22


@pytest.mark.parametrize("protocol", list(U.LAYOUTS))
def test_barcode_calling_without_landmarks(spark, protocol):
    """1 kb reads: no poly-T, a first T-rich window far right of the primer, one left of the primer, and a damaged primer."""
    rnd = random.Random(9)
    layout = U.LAYOUTS[protocol]
    dna = lambda n: "".join(rnd.choice("ACG") for _ in range(n))
    white = sorted({dna(layout["barcode"]) for _ in range(20)})
    rows, want = [], {}
    for k in range(16):
        barcode, umi = rnd.choice(white), dna(layout["umi"])
        middle = barcode + umi if not layout["linker"] else barcode + layout["linker"] + umi if layout.get("linker_after") else barcode[: layout["split"]] + layout["linker"] + barcode[layout["split"] :] + umi
        kind, tail, primer = ("no_tail", "far_tail", "late", "damaged")[k // 4], "T" * 30, layout["primer"]
        seq = {"no_tail": dna(8) + primer + middle + dna(950), "far_tail": dna(8) + primer + middle + dna(500) + tail + dna(400), "late": dna(30) + tail + dna(600) + primer + middle + tail + dna(200), "damaged": dna(60) + primer[-5:] + middle + tail + dna(850)}[kind]
        if k % 2:
            seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        rows.append((f"{kind}{k}", seq))
        want[f"{kind}{k}"] = (barcode, umi, "-" if k % 2 else "+")
    rows += [("none", dna(1000)), ("only_tail", dna(300) + "T" * 30 + dna(600))]
    calls = U.call_barcodes(spark.createDataFrame(rows, "read_id string, seq string"), spark.createDataFrame([(w,) for w in white], "barcode string"), protocol)
    got = {r.read_id: (r.barcode, r.umi, r.strand) for r in calls.collect()}
    assert {k: got[k] for k in want} == want and got["none"][0] is None and got["only_tail"][0] is None


def test_concatemers_and_declared_layouts(spark):
    rnd = random.Random(8)
    dna = lambda n: "".join(rnd.choice("ACG") for _ in range(n))
    layout, white = U.LAYOUTS["tenx_v3"], [dna(16) for _ in range(10)]
    part = lambda b: dna(5) + layout["primer"] + b + dna(12) + "T" * 30 + dna(160)
    reads = spark.createDataFrame([("r", part(white[0]) + part(white[1]))], "read_id string, seq string")
    calls = U.call_barcodes(reads, spark.createDataFrame([(w,) for w in white], "barcode string"), "tenx_v3", split=True)
    assert [r.barcode for r in calls.orderBy("part").collect()] == white[:2]
    elements = readers.parse_molecule(f"P:B:U:PolyT:cDNA\nP CONST {layout['primer']}\nB VAR_ANY 16\nU VAR_ANY 12\n")
    row = U.extract_by_layout(spark.createDataFrame([("r", part(white[2]))], "read_id string, seq string"), elements).head()
    assert row.B == white[2] and len(row.U) == 12


def test_local_alignment():
    assert U.local_align("ACGT", "TTACGTTT") == (4, 2, 5)
    assert U.local_align("ACGT", "TTAGTTT")[0] == 2 and U.local_align("", "A")[0] == 0


def test_adaptive_k():
    assert U.adaptive_k(10, 16) == 6 and U.adaptive_k(3_000_000, 16) > 9 and U.adaptive_k(10**12, 16) == 14


def test_peaks():
    h = np.zeros(60, dtype=int)
    h[[10, 11, 12]], h[[15]], h[[30, 31, 32, 33]], h[45] = [3, 9, 3], [5], [2, 7, 7, 2], 1
    assert T.find_peaks(h).tolist() == [11, 31, 45]
    width, left, right = T.peak_widths(h, np.array([11, 31]))
    assert 9 < left[0] < 10 and 31 < right[1] < 34 and (width > 0).all()
    assert T.find_peaks(np.array([0, 1, 0, 1, 0]), 1).tolist() == [1, 3] and not len(T.find_peaks(np.array([3, 2, 1])))
    assert T.default_scorer(pd.DataFrame({"relative_height": [0.05, 0.5]})).tolist() == [False, True]


def test_fusion_parsing(spark):
    df = spark.createDataFrame([("60S40M", 100, "chr2,5,+,30S80M,60,1;chr3,9,-,20M,60,0;chr4,7,+,50M,5,0;bad;")], "cigar string, pos long, sa string")
    row = df.select(X.clip_side(F.col("cigar")).alias("side"), X.breakpoint(F.col("pos"), F.col("cigar")).alias("at"), X.best_supplementary(X.parse_sa(F.col("sa"))).alias("x")).head()
    assert (row.side, row["at"]) == ("left", 100) and [x.chr for x in row.x] == ["chr2"]
    names = spark.createDataFrame([("TP53-AS1",), ("ENSG000001",), ("RP11-3.1",), ("BRCA1",), (None,)], "g string")
    assert [r[0] for r in names.select(X.label(F.col("g"))).collect()] == ["TP53", "intergenic", "intergenic", "BRCA1", "intergenic"]


def test_interval_join_equals_theta(spark):
    rnd = random.Random(4)
    mk = lambda n, w: [(f"c{rnd.randrange(3)}", s := rnd.randrange(30_000), s + rnd.randrange(w), k) for k in range(n)]
    a, b = mk(200, 9000), mk(200, 300)
    left, right = spark.createDataFrame(a, "chr string, s long, e long, i long"), spark.createDataFrame(b, "chr string, rs long, re long, j long")
    want = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]}
    got = [(r.i, r.j) for r in R.interval_join(left, right, width=512).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.i for r in R.interval_join(left, right, how="left_anti").collect()} == {x[3] for x in a} - {i for i, _ in want}
    assert R.interval_join(left, right, how="left").select("i").distinct().count() == 200


def test_gene_joining_and_clusters(spark):
    t = lambda i, b, a: (i, "c", "+", b, [(x[1] + 1, y[0] - 1) for x, y in zip(b, b[1:], strict=False)], (b[0][0], b[-1][1]), a)
    rows = [t(1, [(1, 10), (21, 30)], 7), t(2, [(5, 10), (21, 40)], None), t(3, [(35, 60)], 8), t(4, [(200, 300)], None), t(5, [(210, 290)], None)]
    df = spark.createDataFrame(rows, f"tx_id long, chr string, strand string, exons array<{I.BLOCK}>, introns array<{I.BLOCK}>, span {I.BLOCK}, annotated long")
    got = {r.tx_id: r.gene for r in G.join_genes(df).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] != got[1]
    counts = spark.createDataFrame([("c", 100, 200, 9), ("c", 103, 201, 2), ("c", 500, 600, 5), ("c", 502, 600, 1), ("c", 900, 950, 1)], "chr string, s long, e long, n long")
    reps = {(r.s, r.e): (r.rep_s, r.rep_e) for r in G.cluster_introns(counts, spark.createDataFrame([("c", 103, 201)], "chr string, s long, e long"), 6, 2).collect()}
    assert reps == {(100, 200): (103, 201), (103, 201): (103, 201), (500, 600): (500, 600), (502, 600): (500, 600), (900, 950): (None, None)}
    pos = spark.createDataFrame([("g", 100, 50), ("g", 120, 5), ("g", 300, 20), ("g", 900, 1)], "k string, pos long, n long")
    assert sorted((r.site, r.reads) for r in G.cluster_positions(pos, ["k"]).collect()) == [(100, 55), (300, 20)]


def test_presets():
    assert with_delta("default", 3).delta == 3 and DISCOVERY["all"].min_novel_count == 1 and MATCHING["exact"].max_intron_abs_diff == 0
    with pytest.raises(ValueError, match="negative"):
        with_delta("default", -1)
