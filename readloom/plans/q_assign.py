"""Queries: read profiles, classification, molecules, terminal sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import classify as K
from ..operators import molecules as U
from ..operators import terminal as T
from .fixtures import Fixtures
from .registry import query


@query("""
with f as (select distinct gene_id, s, e from fx_introns), p as (select r.aln_id, f.s, f.e,
  case when exists (select 1 from fx_read_introns i where i.aln_id = r.aln_id and abs(i.s - f.s) <= 6 and abs(i.e - f.e) <= 6) then 1 when r.s <= f.e and f.s <= r.e and least(r.e, f.e) - greatest(r.s, f.s) + 1 >= 20 then -1 else 0 end as m from fx_reads r join f on r.gene_id = f.gene_id)
select aln_id, string_agg(cast(m as varchar), ',' order by s, e) as profile from p group by aln_id""")
def j4_intron_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read against its gene's introns: 1 matched within 6, -1 absent where the read covers 20 bases of it, 0 unknown."""
    x = Fixtures(spark, sf_dir)
    features = x.introns().groupBy("gene_id").agg(F.array_sort(F.collect_set(I.iv("s", "e"))).alias("features"))
    rows = x.reads().join(features, "gene_id")
    near = lambda f: F.exists("introns", lambda i: I.equal_ranges(i, f, 6))
    mark = F.transform("features", lambda f: F.when(near(f), 1).when(I.intersection_len(F.col("span"), f) >= 20, -1).otherwise(0))
    return rows.select("aln_id", F.array_join(F.transform(mark, lambda m: m.cast("string")), ",").alias("profile"))


@query("""
with f as (select distinct gene_id, s, e from fx_exons), p as (select r.aln_id, f.s, f.e,
  case when exists (select 1 from fx_blocks b where b.aln_id = r.aln_id and b.s <= f.e and f.s <= b.e and least(b.e, f.e) - greatest(b.s, f.s) + 1 >= 5) then 1 when f.s > r.s and f.e < r.e then -1 else 0 end as m from fx_reads r join f on r.gene_id = f.gene_id)
select aln_id, string_agg(cast(m as varchar), ',' order by s, e) as profile, count(case when m = 1 then 1 end) as present from p group by aln_id""")
def j5_exon_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read against its gene's exons, present from 5 common bases on."""
    x = Fixtures(spark, sf_dir)
    features = x.exons().groupBy("gene_id").agg(F.array_sort(F.collect_set(I.iv("s", "e"))).alias("features"))
    rows = x.reads().join(features, "gene_id")
    hit = lambda f: F.exists("blocks", lambda b: I.intersection_len(b, f) >= 5)
    mark = F.transform("features", lambda f: F.when(hit(f), 1).when((f["s"] > F.col("s")) & (f["e"] < F.col("e")), -1).otherwise(0))
    rows = rows.withColumn("_p", mark)
    return rows.select("aln_id", F.array_join(F.transform("_p", lambda m: m.cast("string")), ",").alias("profile"), F.size(F.filter("_p", lambda m: m == 1)).cast("long").alias("present"))


@query("""
with f as (select distinct gene_id, s, e from fx_introns), t as (select gene_id, tx_id, min(s) as ts, max(e) as te from fx_exons group by gene_id, tx_id),
p as (select t.gene_id, t.tx_id, f.s, f.e, case when exists (select 1 from fx_introns i where i.tx_id = t.tx_id and i.s = f.s and i.e = f.e) then 1 when f.s >= t.ts and f.e <= t.te then -1 else -2 end as m from t join f on t.gene_id = f.gene_id)
select a.tx_id as a, b.tx_id as b, count(case when a.m <> b.m then 1 end) as distance, bool_and(a.m = b.m) as equal, count(case when a.m = 1 and b.m = 1 then 1 end) as both_present, bool_and(a.m <> 1 or b.m = 1) as all_present
from p a join p b on a.gene_id = b.gene_id and a.s = b.s and a.e = b.e and a.tx_id < b.tx_id group by a.tx_id, b.tx_id""")
def i18_profile_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and agreement of isoform profiles."""
    x = Fixtures(spark, sf_dir)
    features = x.introns().groupBy("gene_id").agg(F.array_sort(F.collect_set(I.iv("s", "e"))).alias("features"))
    t = x.transcripts().join(features, "gene_id")
    t = t.select("gene_id", "tx_id", F.transform("features", lambda f: F.when(F.array_contains("introns", f), 1).when(I.contains(F.col("span"), f), -1).otherwise(-2)).alias("p"))
    pairs = t.select("gene_id", F.col("tx_id").alias("a"), F.col("p").alias("pa")).join(t.select("gene_id", F.col("tx_id").alias("b"), F.col("p").alias("pb")), "gene_id").where("a < b")
    a, b = F.col("pa"), F.col("pb")
    return pairs.select("a", "b", I.profile_distance(a, b).cast("long").alias("distance"), I.profile_equal(a, b).alias("equal"), I.both_present(a, b).cast("long").alias("both_present"), I.all_present(a, b).alias("all_present"))


_CANDIDATES = """
with rl as (select aln_id, gene_id, min(s) as rs, max(e) as re, sum(e - s + 1) as n from fx_blocks group by aln_id, gene_id),
c as (select b.aln_id, x.tx_id, sum(greatest(0, least(b.e, x.e) - greatest(b.s, x.s) + 1)) as common from fx_blocks b join fx_exons x on b.gene_id = x.gene_id group by b.aln_id, x.tx_id),
t as (select tx_id, gene_id, min(s) as ts, max(e) as te from fx_exons group by tx_id, gene_id),
o as (select b.aln_id, t.tx_id, sum(greatest(0, least(b.e, t.te + 50) - greatest(b.s, t.ts - 50) + 1)) as inside from fx_blocks b join t on b.gene_id = t.gene_id group by b.aln_id, t.tx_id),
ex as (select i.aln_id, t.tx_id, count(*) as n from fx_read_introns i join t on i.gene_id = t.gene_id where not exists (select 1 from fx_introns j where j.tx_id = t.tx_id and abs(i.s - j.s) <= 6 and abs(i.e - j.e) <= 6) group by i.aln_id, t.tx_id),
ms as (select r.aln_id, j.tx_id, count(*) as n from fx_introns j join rl r on j.gene_id = r.gene_id where j.s >= r.rs and j.e <= r.re and not exists (select 1 from fx_read_introns i where i.aln_id = r.aln_id and abs(i.s - j.s) <= 6 and abs(i.e - j.e) <= 6) group by r.aln_id, j.tx_id),
d as (select r.aln_id, t.tx_id, c.common / r.n - (1 - o.inside / r.n) as coverage, coalesce(ex.n, 0) + coalesce(ms.n, 0) + case when rs + 6 < ts then 0.5 else 0 end + case when re - 6 > te then 0.5 else 0 end as distance
  from rl r join t on r.gene_id = t.gene_id join c on c.aln_id = r.aln_id and c.tx_id = t.tx_id join o on o.aln_id = r.aln_id and o.tx_id = t.tx_id left join ex on ex.aln_id = r.aln_id and ex.tx_id = t.tx_id left join ms on ms.aln_id = r.aln_id and ms.tx_id = t.tx_id where c.common > 0),
b as (select *, min(distance) over (partition by aln_id) as best from d where coverage >= -0.5)"""


@query(_CANDIDATES + " select aln_id, tx_id, round(coverage, 6) as coverage, cast(distance as double) as distance from b where distance <= best + 3")
def c5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isoforms that come close to a read."""
    x = Fixtures(spark, sf_dir)
    tx = x.transcripts().select("gene_id", "tx_id", "exons", F.col("introns").alias("tx_introns"), F.col("span").alias("tx_span"))
    return K.candidates(x.reads().select("aln_id", "gene_id", "blocks", "introns", "span"), tx).select("aln_id", "tx_id", F.round("coverage", 6).alias("coverage"), F.col("distance").cast("double").alias("distance"))


@query("""
with rl as (select aln_id, gene_id, sum(e - s + 1) as n from fx_blocks group by aln_id, gene_id), tl as (select tx_id, gene_id, sum(e - s + 1) as m from fx_exons group by tx_id, gene_id),
c as (select b.aln_id, x.tx_id, sum(greatest(0, least(b.e, x.e) - greatest(b.s, x.s) + 1)) as common from fx_blocks b join fx_exons x on b.gene_id = x.gene_id group by b.aln_id, x.tx_id),
s as (select c.aln_id, c.tx_id, round(common / (n + m - common), 9) as score from c join rl using (aln_id) join tl on c.tx_id = tl.tx_id), t as (select *, max(score) over (partition by aln_id) as top from s)
select aln_id, tx_id from t where score >= -0.5 and score * 1.5 >= top""")
def c4_nucleotide_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isoforms whose Jaccard score comes within a factor of the read's best."""
    x = Fixtures(spark, sf_dir)
    p = x.reads().select("aln_id", "gene_id", "blocks").join(x.transcripts().select("tx_id", "gene_id", "exons"), "gene_id")
    return K.tie_break(p, F.round(I.jaccard(F.col("blocks"), F.col("exons")), 9)).select("aln_id", "tx_id")


@query()
def c7_read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of every read against the isoforms that it is assigned to; tested on hand-made cases."""
    x = Fixtures(spark, sf_dir)
    found = K.classify(x.reads(), x.transcripts())
    return found.select("aln_id", "tx_id", "assignment_type", "gene_assignment_type", "class", "penalty", F.array_join(K.names(F.col("events")), ",").alias("events"))


@query()
def c12_assignment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by assignment type and class."""
    x = Fixtures(spark, sf_dir)
    return K.classify(x.reads(), x.transcripts()).groupBy("assignment_type", "class").agg(F.count("*").alias("n"))


@query("""
with t as (select tx_id, string_agg(cast(s as varchar) || '-' || cast(e as varchar), ',' order by s) as introns, min(s) as lo, max(e) as hi from fx_introns group by tx_id),
r as (select r.aln_id, r.src_tx, r.s, r.e, string_agg(cast(i.s as varchar) || '-' || cast(i.e as varchar), ',' order by i.s) as introns from fx_reads r join fx_read_introns i using (aln_id) group by r.aln_id, r.src_tx, r.s, r.e)
select aln_id, case when lo >= r.s and hi <= r.e then 'fsm' when lo < r.s and hi > r.e then 'ism_internal' when lo < r.s then 'ism_left' else 'ism_right' end as kind from r join t on r.src_tx = t.tx_id where contains(t.introns, r.introns)""")
def c14_splice_match_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full or incomplete splice match of reads whose intron chain is part of their transcript's."""
    x = Fixtures(spark, sf_dir)
    r = x.reads().where(F.size("introns") > 0).withColumn("chain", I.blocks_to_text(F.col("introns")))
    t = x.transcripts().where(F.size("introns") > 0).select(F.col("tx_id").alias("src_tx"), I.blocks_to_text(F.col("introns")).alias("tx_chain"), I.region(F.col("introns")).alias("reach"))
    j = r.join(t, "src_tx").where(F.contains("tx_chain", "chain"))
    left, right = F.col("reach.s") < F.col("s"), F.col("reach.e") > F.col("e")
    return j.select("aln_id", F.when(~left & ~right, "fsm").when(left & right, "ism_internal").when(left, "ism_left").otherwise("ism_right").alias("kind"))


_EVENT_SQL = "select aln_id, cast(sum(c) as double) as penalty from (" + " union all ".join(
    f"select aln_id, case when {cond} then {cost} else 0 end as c from fx_aln" for cond, cost in (("q % 3 = 0", 0.1), ("q % 4 = 0", 0.6), ("q % 5 = 0", 1.0), ("q % 7 = 0", 0.75))
) + ") group by aln_id"


@query(f"select aln_id, round(penalty + case when q * 10 <= 50 then 0.1 when q * 10 >= 300 then 0.6 else 0.1 + 0.5 * (q * 10 - 50) / 250.0 end, 6) as penalty from ({_EVENT_SQL}) join fx_aln using (aln_id)")
def c13_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of events, an elongation by its length."""
    x = Fixtures(spark, sf_dir).alignments()
    q = F.col("q")
    e = lambda name, cond, info=0: F.when(cond, F.struct(F.lit(name).alias("event"), F.lit(info).cast("bigint").alias("info") if isinstance(info, int) else info.cast("bigint").alias("info")))
    events = F.array_compact(F.array(e("intron_shift", q % 3 == 0), e("intron_retention", q % 4 == 0), e("exon_skipping_known", q % 5 == 0), e("exon_merge_novel", q % 7 == 0), e("exon_elongation_left", F.lit(True), q * 10)))
    return x.select("aln_id", F.round(K.penalty(events), 6).alias("penalty"))


# ---------------------------------------------------------------- molecules


@query("""
with t as (select *, row_number() over (partition by barcode, gene_id, umi order by case when is_secondary then 0 else 1 end desc, n_blocks desc, e - s desc, aln_id) as nth, count(*) over (partition by barcode, gene_id, umi) as duplicates from (select a.*, r.n_blocks, r.s, r.e from fx_aln a join fx_reads r using (aln_id)))
select aln_id, barcode, gene_id, umi as molecule, duplicates from t where nth = 1""")
def u2_exact_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read per barcode, gene and UMI."""
    x = Fixtures(spark, sf_dir)
    rows = x.alignments().join(x.reads().select("aln_id", "n_blocks", (F.col("e") - F.col("s")).alias("length")), "aln_id").withColumn("kind", F.when(F.col("is_secondary"), "ambiguous").otherwise("unique"))
    rows = U.assign_umis(rows, ["barcode", "gene_id"], "umi", "aln_id", 0)
    return U.representatives(rows, ["barcode", "gene_id"], "kind", "n_blocks", "length", "aln_id").select("aln_id", "barcode", "gene_id", "molecule", "duplicates")


@query()
def u2_greedy_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UMIs clustered at distance 3; the order of merging is not expressible in SQL, u2_cluster_invariant checks it."""
    rows = Fixtures(spark, sf_dir).alignments()
    return U.assign_umis(rows, ["cell_type", "gene_id"], "umi", "aln_id", 3, 8).select("aln_id", "cell_type", "gene_id", "umi", "molecule")


@query("select 0 as close_representatives, 0 as far_members")
def u2_cluster_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No two accepted UMIs of a group are within the distance, and no member is beyond it."""
    found = u2_greedy_molecules(spark, sf_dir).groupBy("cell_type", "gene_id").agg(F.collect_set(F.struct("umi", "molecule")).alias("_m"))
    far = F.size(F.filter("_m", lambda m: F.levenshtein(m["umi"], m["molecule"], 3) < 0))
    found = found.withColumn("_far", far).withColumn("_reps", F.array_sort(F.array_distinct(F.transform("_m", lambda m: m["molecule"]))))
    later = lambda k: F.slice("_reps", k + 2, F.size("_reps"))
    close = F.aggregate(F.transform("_reps", lambda a, k: F.size(F.filter(later(k), lambda b: F.levenshtein(a, b, 3) >= 0))), F.lit(0), lambda n, x: n + x)
    return found.agg(F.coalesce(F.sum(close), F.lit(0)).cast("int").alias("close_representatives"), F.coalesce(F.sum("_far"), F.lit(0)).cast("int").alias("far_members"))


@query("""select cell_type, count(*) as total, count(case when is_secondary then 1 end) as ambiguous, count(case when not is_secondary then 1 end) as unique_reads, count(distinct barcode) as barcodes from fx_aln group by cell_type""")
def u8_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Fixtures(spark, sf_dir).alignments().withColumn("kind", F.when(F.col("is_secondary"), "ambiguous").otherwise("unique"))
    return U.dedup_stats(rows, ["cell_type"], "kind", "barcode").select("cell_type", "total", "ambiguous", "unique_reads", "barcodes")


_KMER_SQL = """
with d as (select doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') as s from documents), b as (select item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') as s from benchmark),
dk as (select distinct doc_id, substr(s, i, 14) as kmer from (select doc_id, s, unnest(range(1, length(s) - 12)) as i from d)), bk as (select distinct item_id, substr(s, i, 14) as kmer from (select item_id, s, unnest(range(1, length(s) - 12)) as i from b)),
h as (select doc_id, item_id, count(*) as shared from dk join bk using (kmer) group by doc_id, item_id), r as (select *, max(shared) over (partition by doc_id) as top, row_number() over (partition by doc_id order by shared desc, item_id) as n from h)
select doc_id, item_id, shared from r where shared >= top - 1 and n <= 10"""


@query(_KMER_SQL)
def j12_kmer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences (the letters of texts) with the ten reference entries, at most, that share most 14-mers; top-k is the operator's feature."""
    x = Fixtures(spark, sf_dir)
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return U.kmer_join(x.table("documents").select("doc_id", letters.alias("qs")), x.table("benchmark").select("item_id", letters.alias("rs")), "doc_id", "item_id", "qs", "rs", 14, delta=1)


@query("""select distinct umi, reverse(translate(umi, 'ACGT', 'TGCA')) as rc, umi as back from fx_aln""")
def p22_sequence_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse complement, and the round trip through two bits a base."""
    u = Fixtures(spark, sf_dir).alignments().select("umi").distinct()
    return u.select("umi", U.reverse_complement(F.col("umi")).alias("rc"), U.decode_2bit(U.encode_2bit(F.col("umi")), F.length("umi")).alias("back"))


@query("""select aln_id, split_part(read_id, '_', 2) as suffix, split_part(barcode, 'C', 2) as bare, coalesce(cell_type, 'NA') as cell from fx_aln""")
def p20_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group ids from read-id suffixes, stripped tags and tables."""
    return Fixtures(spark, sf_dir).alignments().select("aln_id", F.element_at(F.split("read_id", "_"), 2).alias("suffix"), F.regexp_replace("barcode", "^BC", "").alias("bare"), F.coalesce("cell_type", F.lit("NA")).alias("cell"))


# ---------------------------------------------------------------- terminal sites


@query("select tx_id, pos, count(*) as n from fx_pos group by tx_id, pos")
def a13_terminal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.histogram(Fixtures(spark, sf_dir).positions(), ["tx_id"])


@query("""
with h as (select tx_id, min(pos) - 10 as lo, max(pos) + 10 as hi from fx_pos group by tx_id), g as (select tx_id, unnest(range(lo, hi + 1)) as pos, lo from h), c as (select tx_id, pos, count(*) as n from fx_pos group by tx_id, pos)
select g.tx_id, g.lo as start, string_agg(cast(coalesce(c.n, 0) as varchar), ',' order by g.pos) as counts from g left join c on g.tx_id = c.tx_id and g.pos = c.pos group by g.tx_id, g.lo""")
def a13_dense_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-filled histograms with ten zeros on both sides."""
    h = T.dense_histogram(T.histogram(Fixtures(spark, sf_dir).positions(), ["tx_id"]), ["tx_id"])
    return h.select("tx_id", "start", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))


@query("""
with h as (select grp, pos, count(*) as n from fx_pos group by grp, pos), m as (select grp, sum(n) as t, sum(pos * n) / sum(n) as mu, max(pos) - min(pos) + 21 as w from h group by grp),
v as (select h.grp, sum(n * (pos - mu) ** 2) / max(t) as var, sum(n * (pos - mu) ** 3) / max(t) as m3, -sum(n / t * ln(n / t)) as entropy, max(t) as total, max(t) / max(w) as mean_height from h join m on h.grp = m.grp group by h.grp),
o as (select grp, pos, row_number() over (partition by grp order by n desc, pos) as k from h)
select v.grp, cast(total as double) as total, round(var, 4) as var, round(m3 / pow(var, 1.5), 4) as skew, round(entropy, 4) as entropy, o.pos as mode, round(mean_height, 4) as mean_height from v join o on v.grp = o.grp and o.k = 1""")
def a14_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance, biased skewness, entropy, mode and mean height of each group's positions."""
    m = T.moments(T.histogram(Fixtures(spark, sf_dir).positions(), ["grp"]), ["grp"])
    return m.select("grp", "total", F.round("var", 4).alias("var"), F.round("skew", 4).alias("skew"), F.round("entropy", 4).alias("entropy"), "mode", F.round("mean_height", 4).alias("mean_height"))


@query()
def a15_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted peaks with their reads, known within 10 of a group's annotated site; tested against a plain version."""
    x = Fixtures(spark, sf_dir)
    peaks = T.detect(T.histogram(x.positions(), ["grp"]), ["grp"])
    sites = x.positions().groupBy("grp").agg(F.min("pos").alias("site"))
    return T.known_or_novel(peaks, sites, ["grp"])


