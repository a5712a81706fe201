"""The bulk run on a small annotation, and the streaming forms."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from readloom.__main__ import main
from readloom.plans import transcripts
from readloom.sources import readers
from readloom.streaming import events


def cigar(blocks):
    parts = []
    for k, (s, e) in enumerate(blocks):
        parts += ([f"{s - blocks[k - 1][1] - 1}N"] if k else []) + [f"{e - s + 1}M"]
    return "".join(parts)


def test_bulk_run(spark, tmp_path):
    tx = {"T1": [(1000, 1200), (2000, 2200), (3000, 3300)], "T2": [(1000, 1200), (3000, 3300)], "T3": [(9000, 9500)]}
    line = lambda f, s, e, a: f"chr1\tx\t{f}\t{s}\t{e}\t.\t+\t.\t{a}\n"
    gtf = "".join(line("exon", s, e, f'gene_id "{"G2" if t == "T3" else "G1"}"; transcript_id "{t}";') for t, blocks in tx.items() for s, e in blocks)
    (tmp_path / "a.gtf").write_text(gtf)
    novel = [(1000, 1200), (2000, 2200), (2500, 2600), (3000, 3300)]
    reads = [(f"a{k}", 0, tx["T1"], 60) for k in range(4)] + [("b", 0, tx["T2"], 60), ("c", 0, [(9010, 9480)], 60), ("d", 0, [(20_000, 20_100)], 60), ("e", 0, [(3050, 3280)], 60)]
    reads += [(f"n{k}", 0, novel, 60) for k in range(3)] + [("m", 0, tx["T1"], 60), ("m", 256, [(9000, 9400)], 60), ("u", 4, [(1, 2)], 0)]
    sam = "@HD\n" + "".join(f"{r}\t{flag}\tchr1\t{b[0][0]}\t{q}\t{cigar(b)}\t*\t0\t0\t*\t*\n" for r, flag, b, q in reads)
    (tmp_path / "r.sam").write_text(sam)
    main(["--gtf", str(tmp_path / "a.gtf"), "--sam", str(tmp_path / "r.sam"), "--out", str(tmp_path / "out"), "--by-file", "--secondary"])
    read = lambda n: spark.read.csv(str(tmp_path / "out" / n), sep="\t", header=True)
    kinds = {r.read_id: (r.assignment_type, r.isoform_id) for r in read("read_assignments").collect()}
    assert kinds["a0"] == ("unique", "T1") and kinds["b"] == ("unique", "T2") and kinds["c"] == ("unique", "T3") and kinds["m"] == ("unique", "T1")
    assert kinds["d"][0] == "intergenic" and kinds["e"] == ("ambiguous", "T1,T2") and kinds["n0"][0] == "inconsistent_ambiguous" and "u" not in kinds
    genes = {r.gene: float(r["count"]) for r in read("gene_counts").collect()}
    assert genes == {"G1": 7.0, "G2": 1.0} and {r.transcript: float(r["count"]) for r in read("transcript_counts").collect() if float(r["count"]) > 0} == {"T1": 5.0, "T2": 1.0}
    assert {(r.kind, int(r.n)) for r in read("models").collect()} == {("known", 5), ("known", 1), ("NNIC", 3)}  # T2's chain: min_known_count is 1


def test_bulk_run_known_models_need_fewer_reads(spark, tmp_path):
    """Annotated chains of 2 reads and of 1, new ones of 3 and of 2, under presets with known and novel cutoffs (1, 3) and (2, 8)."""
    tx = {"T1": [(1000, 1200), (2000, 2200), (3000, 3300)], "T2": [(1000, 1200), (3000, 3300)]}
    (tmp_path / "a.gtf").write_text("".join(f'chr1\tx\texon\t{s}\t{e}\t.\t+\t.\tgene_id "G1"; transcript_id "{t}";\n' for t, blocks in tx.items() for s, e in blocks))
    novel = lambda s: [(1000, 1200), (2000, 2200), (s, 2600), (3000, 3300)]
    reads = [("a1", tx["T1"]), ("a2", tx["T1"]), ("b", tx["T2"])] + [(f"n{k}", novel(2500)) for k in range(3)] + [(f"o{k}", novel(2400)) for k in range(2)]
    (tmp_path / "r.sam").write_text("@HD\n" + "".join(f"{r}\t0\tchr1\t{b[0][0]}\t60\t{cigar(b)}\t*\t0\t0\t*\t*\n" for r, b in reads))
    exons = readers.exons_of(readers.read_gtf(spark, str(tmp_path / "a.gtf")))
    rows = transcripts.alignment_blocks(readers.read_sam(spark, str(tmp_path / "r.sam")))
    found = {p: sorted((r.kind, r.n) for r in transcripts.analyze(rows, exons, models=p).models.collect()) for p in ("default_ont", "reliable")}
    assert found == {"default_ont": [("NNIC", 3), ("known", 1), ("known", 2)], "reliable": [("known", 2)]}


def test_streams_match_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(k % 2, t0 + timedelta(minutes=m), f"u{m // 20}") for k, m in enumerate((0, 1, 5, 6, 40, 41, 90, 95))] + [(9, t0 + timedelta(days=2), "z")]
    spark.createDataFrame(rows, "k int, ts timestamp, umi string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k int, ts timestamp, umi string").parquet(str(tmp_path / "in"))
    for n, df in enumerate((events.sessions(stream(), "k", "ts"), events.first_molecules(stream(), ["k", "umi"], "ts"))):
        name = f"out{n}"
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    batch = events.sessions(spark.read.parquet(str(tmp_path / "in")), "k", "ts").where("k < 9")
    assert {tuple(r) for r in spark.table("out0").where("k < 9").collect()} == {tuple(r) for r in batch.collect()}
    assert spark.table("out1").where("k < 9").count() == spark.read.parquet(str(tmp_path / "in")).where("k < 9").select("k", "umi").distinct().agg(F.count("*")).head()[0]
