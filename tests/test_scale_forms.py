"""Operators in their scalable form against plain versions: sweeps, numbers, components, windows, ids, paths, barcodes, stages."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from readloom.functions import intervals as I
from readloom.operators import classify as K
from readloom.operators import discovery as G
from readloom.operators import fusion as X
from readloom.operators import lookups as L
from readloom.operators import models as M
from readloom.operators import molecules as U
from readloom.operators import ordering as O
from readloom.operators.components import components
from readloom.sources import readers

IV = "struct<s:bigint,e:bigint>"


@pytest.mark.parametrize("gap", [0, 40])
def test_sweep_over_stretches(spark, gap):
    rnd = random.Random(3)
    rows = [("chr1", s := rnd.randrange(20_000), s + rnd.choice([5, 30, 300, 4_000])) for _ in range(250)] + [("chr2", 5, 9), ("chr2", 5, 9)]
    found = O.sweep(spark.createDataFrame(rows, "chr string, s long, e long"), ["chr"], "s", "e", gap, "k", stretch=256).collect()
    want, last, k = [], None, 0
    for c, s, e in sorted(rows):
        if last is None or last[0] != c:
            last, k = (c, -(10**9)), 0
        if s > last[1] + gap:
            k += 1
        last = (c, max(last[1], e))
        want.append((c, s, e, k))
    assert sorted((r.chr, r.s, r.e, r.k) for r in found) == sorted(want)


def test_numbers_and_running_sums(spark):
    rnd = random.Random(4)
    values = rnd.sample(range(10_000), 300)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v long, w long").repartition(7)
    assert {r.v: r.k for r in O.numbered(df, ["v"], "k").collect()} == {v: k for k, v in enumerate(sorted(values), 1)}
    got = {r.v: r.b for r in O.running_before(df, [], "v", "w", "b").collect()}
    assert got == {v: sum(x % 7 for x in values if x < v) for v in values}


def test_components_of_a_long_chain(spark):
    n = 3_000
    edges = [(k, k + 1) for k in range(n)] + [(n + 10, n + 11), (n + 20, n + 20)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, n + 10: n + 10, n + 11: n + 10, n + 20: n + 20}


def test_graph_components_have_no_longest_path(spark):
    chains = [("c", [(100 * k, 100 * k + 50), (100 * k + 100, 100 * k + 150)]) for k in range(60)] + [("c", [(90_000, 90_010)]), ("d", [(0, 50)])]
    got = G.graph_components(spark.createDataFrame(chains, f"chr string, introns array<{IV}>")).collect()
    assert sorted(Counter(r.component for r in got).values()) == [1, 1, 61]


def most_rows(df):
    """The most rows that an operator of a plan made, by its counters."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        name = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        below = node.children()
        todo += inner + [below.apply(k) for k in range(below.size())]
    return most


@pytest.mark.parametrize("w", [8, 50, 2000])
def test_densest_window(spark, w):
    rnd = random.Random(w)
    points = [(k, rnd.randrange(-300, 3 * w), rnd.randrange(0, 3 * w)) for k in ("x", "y") for _ in range(150)] + [("z", 5, 5)]
    got = {r.key: (r.window_reads, r.consensus_a, r.consensus_b) for r in X.consensus(spark.createDataFrame(points, "key string, pos_a long, pos_b long"), ["key"], w).collect()}
    for key in "xyz":
        own = [(a, b) for k, a, b in points if k == key]
        best = min(((-len(p := [(a, b) for a, b in own if a0 <= a < a0 + w and b0 <= b < b0 + w]), a0, b0, p) for a0, b0 in set(own)), key=lambda x: x[:3])
        p = best[3]
        div = lambda x, n: int(x / n)
        assert got[key] == (len(p), div(sum(a for a, _ in p), len(p)), div(sum(b for _, b in p), len(p)))


def test_evenly_filled_windows_are_not_paired(spark):
    """40,000 evenly filled places of two keys, where no bound rules a window out: places meet each other in no join. A plain sum agrees."""
    n = {(a, b): 1 + (a * 7 + b * 13) % 5 for a in range(200) for b in range(100)}
    df = spark.range(40_000).selectExpr("id % 2 as key", "id div 200 as a", "id div 2 % 100 as b").selectExpr("key", "a as pos_a", "b as pos_b", "explode(sequence(1, 1 + (a * 7 + b * 13) % 5)) as k").drop("k")
    found = X.consensus(df, ["key"], 60)
    got = {r.key: tuple(r)[1:] for r in found.collect()}
    tops = [(-sum(n.get((a, b), 0) for a in range(a0, a0 + 60) for b in range(b0, b0 + 60)), a0, b0) for a0 in range(0, 141) for b0 in range(0, 41)]
    reads, a0, b0 = min(tops)
    inside = [(a, b, n[a, b]) for a in range(a0, a0 + 60) for b in range(b0, b0 + 60)]
    want = (-reads, sum(a * k for a, _, k in inside) // -reads, sum(b * k for _, b, k in inside) // -reads)
    assert got == {0: want, 1: want}
    assert most_rows(found) <= 4 * 20_000 * 2


def test_ids_past_those_taken(spark):
    rnd = random.Random(6)
    for taken in ([], [1, 2, 3], rnd.sample(range(1, 200), 90), [5, 5, -3, 0]):
        free, k = [], 0
        while len(free) < 60:
            k += 1
            if k not in taken:
                free.append(k)
        got = L.new_ids(spark.createDataFrame([(f"f{i:03}",) for i in range(60)], "name string"), spark.createDataFrame([(t,) for t in taken], "id long"), ["name"]).orderBy("name").collect()
        assert [r.id for r in got] == free


# ---------------------------------------------------------------- paths


def plain_end(vertices, end, limit, trusted, confirmed, started, bare, p=50, delta=6):
    near = lambda kind: min(((abs(x - end), x, k) for k, x in vertices if k == kind and abs(x - end) <= p), default=None)
    if trusted and near(confirmed):
        return confirmed, near(confirmed)[1]
    if limit is not None and not trusted and end <= limit + delta:
        return None
    if near(started):
        return started, near(started)[1]
    ranked = sorted((x, k) for k, x in vertices)
    if not ranked:
        return None
    x, k = ranked[-1]
    if trusted and end >= x and k == bare:
        return k, x
    if not trusted and end <= x + p and (len(ranked) < 2 or end > ranked[-2][0]):
        return k, x
    return None


def test_paths_against_plain_version(spark):
    rnd = random.Random(8)
    introns = [(1000, 2000), (3000, 4000), (5000, 6000)]
    terminals, edges = [], [("c", 1000, 2000, 3000, 4000), ("c", 3000, 4000, 5000, 6000), ("c", 3000, 4000, 5600, 5900)]
    for s, e in introns:
        terminals += [("c", s, e, "right", k, e + rnd.randrange(100, 900)) for k in rnd.choices(["polya", "tss", "end"], k=3)]
        terminals += [("c", s, e, "left", k, s - rnd.randrange(100, 900)) for k in rnd.choices(["polyt", "tss", "start"], k=3)]
    reads = []
    for i in range(300):
        a, b = sorted(rnd.sample(range(4), 2))
        own = introns[a:b]
        span = (own[0][0] - rnd.randrange(1, 1000), own[-1][1] + rnd.randrange(1, 1000))
        reads.append((f"r{i}", "c", rnd.choice("+-"), own, span, rnd.choice([None, span[1]]), rnd.choice([None, span[0]])))
    df = spark.createDataFrame(reads, f"read_id string, chr string, strand string, introns array<{IV}>, span {IV}, polya long, polyt long")
    found = M.thread_paths(df, spark.createDataFrame(edges, "chr string, s long, e long, ns long, ne long"), spark.createDataFrame(terminals, "chr string, s long, e long, side string, kind string, pos long"))
    got = {r.read_id: r for r in found.collect()}
    for rid, _, strand, own, span, polya, polyt in reads:
        hung = lambda i, side: [(k, x) for _, s, e, d, k, x in terminals if (s, e) == i and d == side]
        after = max([ns - 1 for _, s, e, ns, _ in edges if (s, e) == own[-1]], default=None)
        before = min([e + 1 for _, _, e, ns, ne in edges if (ns, ne) == own[0]], default=None)
        right = plain_end(hung(own[-1], "right"), span[1], after, strand == "+" and polya is not None, "polya", "tss", "end")
        left = plain_end([(k, -x) for k, x in hung(own[0], "left")], -span[0], None if before is None else -before, strand == "-" and polyt is not None, "polyt", "tss", "start")
        left = left and (left[0], -left[1])
        r = got[rid]
        assert (r.right and tuple(r.right)) == right and (r.left and tuple(r.left)) == left, rid
        assert r.full == bool(left and right and (right[0] == "polya" or left[0] == "polyt"))


# ---------------------------------------------------------------- barcodes


def test_best_barcode_misses_none():
    rnd = random.Random(2)
    base = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    whitelist = [base(16) for _ in range(60)]
    whitelist += [w[:8] + base(8) for w in whitelist[:40]]  # many that share k-mers
    index = {}
    for i, b in enumerate(whitelist):
        for j in range(len(b) - 5):
            index.setdefault(b[j : j + 6], []).append(i)
    for _ in range(300):
        w = list(rnd.choice(whitelist))
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w))
            w[k : k + 1] = rnd.choice([[], [base(1)], [w[k], base(1)]])
        text = base(2) + "".join(w) + base(2)
        shared = {i for j in range(len(text) - 5) for i in index.get(text[j : j + 6], ())}
        scored = sorted(((U.local_align(whitelist[i], text)[0], whitelist[i]) for i in shared), reverse=True)
        want = scored[0][1] if scored and scored[0][0] >= 13 and (len(scored) < 2 or scored[0][0] > scored[1][0]) else None
        assert U.best_barcode(text, whitelist, index, 6, 13)[0] == want


def test_two_part_barcodes(spark):
    rnd = random.Random(5)
    base = lambda n: "".join(rnd.choice("ACG") for _ in range(n))
    first, second = [base(16) for _ in range(20)], [base(15) for _ in range(20)]
    rows, want = [], {}
    for i in range(30):
        a, b, umi = rnd.choice(first), rnd.choice(second), base(9)
        read = base(30) + U.VISIUM_HD["primer"] + umi + a + b + "CA" + "T" * 30 + base(200)
        rows.append((f"r{i}", U._revcomp(read) if i % 2 else read))
        want[f"r{i}"] = (f"{a}|{b}", umi, "-" if i % 2 else "+")
    rows += [("none", base(300)), ("null", None), ("empty", "")]
    parts = [spark.createDataFrame([(x,) for x in p], "part string") for p in (first, second)]
    got = {r.read_id: (r.barcode, r.umi, r.strand) for r in U.call_two_part_barcodes(spark.createDataFrame(rows, "read_id string, seq string"), *parts).collect()}
    assert {k: got[k] for k in want} == want and all(got[k][0] is None for k in ("none", "null", "empty"))


# ---------------------------------------------------------------- stages and files


def test_stages_are_saved_and_replayed(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "read_id string, n int")
    readers.save_stage(df, str(tmp_path), "assigned")
    dropped = spark.createDataFrame([("b",), ("b",)], "read_id string")
    assert {r.read_id for r in readers.replay(spark, str(tmp_path), "assigned", dropped).collect()} == {"a", "c"}
    assert readers.replay(spark, str(tmp_path), "assigned").count() == 3


def test_regions_from_scan_or_storage(spark):
    reads = spark.createDataFrame([("r1", "c", 10, 50), ("r2", "c", 900, 990)], "aln_id string, chr string, s long, e long")
    wanted = spark.createDataFrame([("c", 1, 20)], "chr string, rs long, re long")
    assert [r.aln_id for r in readers.region_reads(reads, wanted).collect()] == [r.aln_id for r in readers.region_reads(reads, wanted, in_memory=True).collect()] == ["r1"]
    reads.unpersist()


def test_repeated_ids_of_an_annotation(spark, tmp_path):
    lines = [f"c\tx\t{f}\t{s}\t{e}\t.\t+\t.\tgene_id \"g\"; transcript_id \"t\";" for at in (100, 5000) for f, s, e in (("transcript", at, at + 500), ("exon", at, at + 100), ("exon", at + 300, at + 500))]
    (tmp_path / "a.gtf").write_text("\n".join(["# note", *lines, "broken line"]))
    got = Counter(r.transcript_id for r in readers.validated(readers.read_gtf(spark, str(tmp_path / "a.gtf"))).collect())
    assert got == {"t": 3, "t.1": 3}


def test_novel_models_and_similar_ones(spark):
    iso = [(100, 200), (300, 400), (500, 600), (700, 900)]
    rows = [("long", "known", iso, 9), ("short", "NIC", iso[:3], 4), ("other", "NIC", [(100, 200), (300, 430), (500, 600)], 4), ("twin", "NIC", [(110, 200), (300, 400), (500, 600), (700, 880)], 2)]
    df = spark.createDataFrame([(n, k, "c", "+", b, r, False) for n, k, b, r in rows], f"model string, kind string, chr string, strand string, exons array<{IV}>, reads long, polya_confirmed boolean")
    df = df.withColumn("introns", I.junctions(F.col("exons"))).withColumn("span", I.region(F.col("exons")))
    assert {r.model: r["into"] for r in M.similar_models(df).collect()} == {"short": "long", "twin": "long"}
    assert {r.model for r in M.substitute_models(df, M.similar_models(df)).collect()} == {"long", "other"}


def test_routes_of_odd_reads(spark):
    """Nested, antisense and unspliced genes: reads in introns, beside genes, and over both."""
    tx = [("t1", "g1", [(1000, 1200), (3000, 3200), (6000, 6300)]), ("t2", "g1", [(1000, 1200), (6000, 6300)]), ("n1", "g2", [(2000, 2400)])]
    t = spark.createDataFrame(tx, f"tx_id string, gene_id string, exons array<{IV}>").withColumn("introns", I.junctions(F.col("exons"))).withColumn("span", I.region(F.col("exons")))
    reads = [("full", "g1", tx[0][2]), ("skip", "g1", tx[1][2]), ("intron", "g1", [(4000, 4500)]), ("beside", "g1", [(9000, 9500)]), ("novel", "g1", [(1000, 1200), (4000, 4100), (6000, 6300)]), ("nested", "g2", [(2010, 2390)]), ("over", "g2", [(1990, 2410)])]
    r = spark.createDataFrame(reads, f"aln_id string, gene_id string, blocks array<{IV}>").withColumn("introns", I.junctions(F.col("blocks"))).withColumn("span", I.region(F.col("blocks")))
    paths = {x.aln_id: x.path for x in K.profiled(r, t).collect()}
    assert paths == {"full": "consistent", "skip": "consistent", "intron": "genic_intron", "beside": "intergenic", "novel": "inconsistent", "nested": "consistent", "over": "consistent"}
    assert {(x.aln_id, x.tx_id) for x in K.consistent_isoforms(r, t).collect()} == {("full", "t1"), ("skip", "t2"), ("nested", "n1"), ("over", "n1")}


@pytest.mark.parametrize("lost", ["left", "right"])
def test_path_invariants_ask_what_is_threaded(spark, monkeypatch, lost):
    """Paths of which an end is not found are no longer 0, 0, 0."""
    from readloom.plans import QUERIES, q_more

    thread = M.thread_paths

    def worse(reads, *rest):
        t = thread(reads, *rest)
        return t.withColumn(lost, F.lit(None).cast(t.schema[lost].dataType)).withColumn("full", F.lit(False))

    small = "/root/testdata/sf0.001"
    monkeypatch.setattr(q_more.G, "thread_paths", worse)
    assert sum(QUERIES["g9_path_invariants"](spark, small).head()) > 0


def test_umis_are_clustered_without_python(spark):
    """Clusters of the column form equal the plain version's, and the plan runs no Python."""
    rnd = random.Random(5)
    bases = ["".join(rnd.choice("ACGT") for _ in range(rnd.choice([7, 8, 8, 10]))) for _ in range(12)]
    cut = lambda u, k: u[:k] + rnd.choice(["", "A", "CG"]) + u[k + 1 :]
    rows = [(n % 9, f"r{n}", cut(cut(rnd.choice(bases), rnd.randrange(6)), rnd.randrange(6))) for n in range(500)] + [(0, "x", None), (1, "y", "*")]
    found = U.assign_umis(spark.createDataFrame(rows, "g int, id string, umi string"), ["g"], "umi", "id", 2, 8)
    assert "Pandas" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    want = {(g, u): m for g in range(9) for u, m in U.cluster_umis(Counter(u for h, _, u in rows if h == g and u not in (None, "*")), 2, 8).items()}
    assert {(r.g, r.umi): r.molecule for r in found.collect()} == want | {(0, None): None, (1, "*"): None}


def test_loci_are_joined_many_at_a_time(spark):
    """2,000 loci do not make as many calls of Python; each has its own genes, whatever the order of its models."""
    x = lambda i, at: (i, "c", "+", [(at + 11, at + 20)], (at, at + 30), 7 * i if i % 2 else None)
    rows = [x(2 * k + d, 100 * k + d) for k in range(2_000) for d in (0, 1)]
    found = G.join_genes(spark.createDataFrame(rows[::-1], f"tx_id long, chr string, strand string, introns array<{IV}>, span {IV}, annotated long"))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert all((r.gene, r.annotated_gene) == (f"c_+_{r.tx_id | 1}", 7 * (r.tx_id | 1)) for r in found.collect()) and found.count() == 4_000


def test_kmers_are_looked_up_before_they_are_cut_out(spark):
    """Texts of other alphabets, short ones and nulls: counts equal sets, and the plan makes no row for every place of a query."""
    rnd = random.Random(8)
    word = lambda n, letters="abc": "".join(rnd.choice(letters) for _ in range(n))
    refs = [(k, word(40, "abc\u00e9\U0001f600") if k % 3 else word(40)) for k in range(12)]
    texts = [(100 + k, word(15) + refs[k % 12][1][k % 7 : 30] + word(k % 9)) for k in range(60)] + [(1, None), (2, ""), (3, "ab"), (4, refs[0][1] * 40), (5, word(3_000))]
    df = lambda rows, names: spark.createDataFrame(rows, names)
    found = U.kmer_join(df(texts, "q long, qs string"), df(refs, "r long, rs string"), "q", "r", "qs", "rs", 9, top=3, delta=2)
    cut = lambda t: {t[i : i + 9] for i in range(len(t) - 8)}
    want = set()
    for q, t in texts:
        n = sorted((-len(cut(t) & cut(s)), r) for r, s in refs if cut(t) & cut(s)) if t else []
        want |= {(q, r, -c) for c, r in n[:3] if c <= n[0][0] + 2}
    assert {tuple(r) for r in found.select("q", "r", "shared").collect()} == want
    assert most_rows(found) < 2_500 < sum(max(0, len(t or "") - 8) for _, t in texts)
    at = U.rolling_hashes(U._points("abcdefgabcdefg"), 7)
    assert at[0] == at[7] and len(set(at.tolist())) == 7


@pytest.mark.parametrize("made", ["exons", "transcripts"])
def test_exons_are_not_taken_for_small(spark, made):
    """Spark's estimate of exons, and of what is made of them, is not below what they hold, so that large ones are not broadcast."""
    from readloom.plans.fixtures import Fixtures

    df = getattr(Fixtures(spark, "/root/testdata/sf0.001"), made)()
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert estimate >= 40 * Fixtures(spark, "/root/testdata/sf0.001").exons().count()
