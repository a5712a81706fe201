"""Queries: fusions, rankings, evaluation, graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discovery as G
from ..operators import evaluation as V
from ..operators import fusion as X
from .fixtures import Fixtures
from .registry import query

# A split read: two alignments of one read id in different genes; clips and lengths come from q.
_PAIRS = """
select distinct a.read_id, 'G' || cast(a.gene_id as varchar) as left_gene, 'chr' || cast(a.gene_id % 5 as varchar) as left_chr, a.gene_id * 1500 + a.q as left_pos, 'G' || cast(b.gene_id as varchar) as right_gene, 'chr' || cast(b.gene_id % 5 as varchar) as right_chr, b.gene_id * 1500 + b.q as right_pos
from fx_aln a join fx_aln b on a.read_id = b.read_id and a.aln_id < b.aln_id where a.mapq >= 12 and b.mapq >= 12 and a.gene_id <> b.gene_id"""


def _pairs(x: Fixtures) -> DataFrame:
    a = x.alignments().where("mapq >= 12").select("read_id", "aln_id", "gene_id", "q")
    b = a.select("read_id", F.col("aln_id").alias("b_id"), F.col("gene_id").alias("b_gene"), F.col("q").alias("bq"))
    p = a.join(b, "read_id").where("aln_id < b_id and gene_id != b_gene")
    side = lambda g, q, n: [F.concat(F.lit("G"), F.col(g).cast("string")).alias(f"{n}_gene"), F.concat(F.lit("chr"), (F.col(g) % 5).cast("string")).alias(f"{n}_chr"), (F.col(g) * 1500 + F.col(q)).alias(f"{n}_pos")]
    return p.select("read_id", *side("gene_id", "q", "left"), *side("b_gene", "bq", "right")).distinct()


_CIGAR = "select aln_id, cast(q * 3 as varchar) || 'S' || cast(100 + q as varchar) || 'M' || cast(mapq + 1 as varchar) || 'D' || '50M' || case when q % 2 = 0 then cast(q + 20 as varchar) || 'S' else '' end as cigar, cast(1000 + q as bigint) as pos, q, mapq from fx_aln"


def _cigars(x: Fixtures) -> DataFrame:
    q, t = F.col("q"), lambda c: c.cast("string")
    cigar = F.concat(t(q * 3), F.lit("S"), t(q + 100), F.lit("M"), t(F.col("mapq") + 1), F.lit("D50M"), F.when(q % 2 == 0, F.concat(t(q + 20), F.lit("S"))).otherwise(""))
    return x.alignments().select("aln_id", cigar.alias("cigar"), (q + 1000).alias("pos"), "q", "mapq")


@query(f"""with c as ({_CIGAR}), k as (select *, q * 3 >= 50 as l, q % 2 = 0 and q + 20 >= 50 as r, pos + 100 + q + mapq + 1 + 50 - 1 as stop from c)
select aln_id, 150 + q as aligned, 151 + q + mapq as reference, case when l and not r then 'left' when r and not l then 'right' end as side, case when l and not r then pos when r and not l then stop else cast(floor((pos + stop) / 2) as bigint) end as breakpoint from k""")
def x2_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned length, clip side and breakpoint from CIGAR strings."""
    c = F.col("cigar")
    return _cigars(Fixtures(spark, sf_dir)).select("aln_id", X.cigar_length(c).alias("aligned"), X.reference_length(c).alias("reference"), X.clip_side(c).alias("side"), X.breakpoint(F.col("pos"), c).alias("breakpoint"))


@query(f"""with p as ({_PAIRS}), k as (select *, row_number() over (partition by read_id, left_chr, floor(left_pos / 50), right_chr, floor(right_pos / 50) order by left_pos, right_pos) as n from p) select read_id, left_chr, left_pos, right_chr, right_pos from k where n = 1""")
def x3_pair_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dedup_pairs(_pairs(Fixtures(spark, sf_dir))).select("read_id", "left_chr", "left_pos", "right_chr", "right_pos")


_AGG = f"""p as ({_PAIRS}), o as (select read_id, least(left_gene, right_gene) as gene_a, greatest(left_gene, right_gene) as gene_b, case when left_gene > right_gene then right_chr else left_chr end as chr_a, case when left_gene > right_gene then left_chr else right_chr end as chr_b,
  case when left_gene > right_gene then right_pos else left_pos end as pos_a, case when left_gene > right_gene then left_pos else right_pos end as pos_b from p),
c as (select gene_a, gene_b, chr_a, chr_b, count(distinct read_id) as support, min(pos_a) as min_a, max(pos_a) as max_a, min(pos_b) as min_b, max(pos_b) as max_b from o group by gene_a, gene_b, chr_a, chr_b),
n as (select gene, count(*) as n from (select gene_a as gene from c union all select gene_b from c) group by gene)"""


@query(f"with {_AGG} select * from c")
def x6_fusion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.aggregate(_pairs(Fixtures(spark, sf_dir)))


@query(f"""with {_AGG} select gene_a, gene_b, exists (select 1 from n where n.n > 4 and (n.gene = gene_a or n.gene = gene_b)) as frequent, case when chr_a = chr_b and abs(min_b - max_a) <= 200000 then 'cis-SAGe' when chr_a = chr_b then 'intrachromosomal' else 'interchromosomal' end as class,
 support >= 2 and not exists (select 1 from n where n.n > 4 and (n.gene = gene_a or n.gene = gene_b)) as valid,
 cast(round(least(1.0, greatest(0.0, 0.5 + least(support, 10) * 0.05 - 0.3 * (case when support < 2 then 1 else 0 end + case when exists (select 1 from n where n.n > 4 and (n.gene = gene_a or n.gene = gene_b)) then 1 else 0 end))), 3) as double) as confidence from c""")
def x9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency filter, class, reasons and confidence."""
    found = X.validate(X.gene_frequency(X.aggregate(_pairs(Fixtures(spark, sf_dir)))), 2, 200000)
    return found.select("gene_a", "gene_b", "frequent", "class", "valid", "confidence")


@query("""with p as (select tag_group as key, gene_id * 37 % 9000 as pos_a, q * 150 as pos_b from fx_aln), n as (select key, pos_a, pos_b, count(*) as n from p group by key, pos_a, pos_b),
w as (select a.key, a.pos_a as a0, a.pos_b as b0, sum(b.n) as reads, sum(b.pos_a * b.n) as sa, sum(b.pos_b * b.n) as sb from n a join n b on a.key = b.key and b.pos_a >= a.pos_a and b.pos_a < a.pos_a + 2000 and b.pos_b >= a.pos_b and b.pos_b < a.pos_b + 2000 group by a.key, a.pos_a, a.pos_b),
r as (select *, row_number() over (partition by key order by reads desc, a0, b0) as k from w)
select key, cast(reads as bigint) as window_reads, cast(floor(sa / reads) as bigint) as consensus_a, cast(floor(sb / reads) as bigint) as consensus_b from r where k = 1""")
def a19_breakpoint_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densest window of breakpoints of each key."""
    p = Fixtures(spark, sf_dir).alignments().select(F.col("tag_group").alias("key"), (F.col("gene_id") * 37 % 9000).alias("pos_a"), (F.col("q") * 150).alias("pos_b"))
    return X.consensus(p, ["key"])


@query("""select read_id, gene, exonic from (select read_id, 'G' || cast(gene_id as varchar) as gene, bool_or(q > 25) as exonic, row_number() over (partition by read_id order by case when bool_or(q > 25) then 0 else 1 end, 'G' || cast(gene_id as varchar)) as n from fx_aln group by read_id, gene_id) where n = 1""")
def x4_gene_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gene per read: exonic first, then by name."""
    hits = Fixtures(spark, sf_dir).alignments().groupBy("read_id", F.concat(F.lit("G"), F.col("gene_id").cast("string")).alias("gene")).agg(F.max(F.col("q") > 25).alias("exonic"))
    return X.choose_gene(hits, ["read_id"])


@query("""with c as (select gene_id, src_tx, cell_type, count(*) as n from fx_aln group by gene_id, src_tx, cell_type), s as (select src_tx, cell_type, sum(n) as v from c group by src_tx, cell_type), m as (select *, max(v) over (partition by src_tx) as m from s) select src_tx, cell_type, cast(v as bigint) as value from m where m >= 8""")
def a16_value_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Fixtures(spark, sf_dir).alignments().groupBy("gene_id", "src_tx", "cell_type").agg(F.count("*").alias("count"))
    return V.value_sums(counts, "src_tx", "cell_type", least=8)


_DEV = """w as (select gene_id, src_tx, count(case when cell_type = 'BUILDING' then 1 end) as va, count(case when cell_type = 'MACHINERY' then 1 end) as vb from fx_aln where cell_type in ('BUILDING', 'MACHINERY') group by gene_id, src_tx),
f as (select *, case when sum(va) over (partition by gene_id) > 0 then va / sum(va) over (partition by gene_id) else 0 end as fa, case when sum(vb) over (partition by gene_id) > 0 then vb / sum(vb) over (partition by gene_id) else 0 end as fb from w),
d as (select gene_id, sqrt(sum((fa - fb) ** 2)) * case when count(*) = 1 then 0.7 else 1 end as deviance, count(*) as n_isoforms, sum(va) as total_a, sum(vb) as total_b from f group by gene_id)"""


def _deviance(x: Fixtures) -> DataFrame:
    counts = x.alignments().groupBy("gene_id", "src_tx", "cell_type").agg(F.count("*").alias("count"))
    return V.usage_deviance(counts, "gene_id", "src_tx", "cell_type", "BUILDING", "MACHINERY")


@query(f"with {_DEV} select gene_id, round(deviance, 6) as deviance, n_isoforms, cast(total_a as bigint) as total_a, cast(total_b as bigint) as total_b from d")
def a17_usage_deviance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deviance(Fixtures(spark, sf_dir)).withColumn("deviance", F.round("deviance", 6))


@query(f"""with {_DEV}, r as (select gene_id, (total_a + total_b) / 2.0 as mean_value, cast(abs(total_a - total_b) as double) as difference, round(deviance, 9) as deviance from d),
k as (select *, rank() over (order by mean_value) + (count(*) over (partition by mean_value) - 1) / 2.0 + rank() over (order by difference) + (count(*) over (partition by difference) - 1) / 2.0 + rank() over (order by deviance) + (count(*) over (partition by deviance) - 1) / 2.0 as rank_sum from r)
select gene_id, cast(mean_value as double) as mean_value, difference, round(deviance, 6) as deviance, cast(rank_sum as double) as rank_sum from k""")
def a18_gene_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.gene_ranking(_deviance(Fixtures(spark, sf_dir)), "gene_id")
    return r.select("gene_id", F.col("mean_value").cast("double").alias("mean_value"), "difference", F.round("deviance", 6).alias("deviance"), F.col("rank_sum").cast("double").alias("rank_sum"))


_TWO = """o as (select gene_id, cast(count(*) as double) as count from fx_aln where not is_secondary group by gene_id), x as (select gene_id, cast(count(*) as double) as count from fx_aln where mapq >= 12 and cell_type <> 'BUILDING' group by gene_id)"""


def _two(x: Fixtures) -> tuple[DataFrame, DataFrame]:
    n = F.count("*").cast("double").alias("count")
    return x.alignments().where("not is_secondary").groupBy("gene_id").agg(n), x.alignments().where("mapq >= 12 and cell_type != 'BUILDING'").groupBy("gene_id").agg(n)


@query(f"""with {_TWO}, b as (select coalesce(o.count, 0) as o, coalesce(x.count, 0) as x from o full join x using (gene_id))
select round(corr(o, x), 6) as correlation, count(case when x > 0 and o = x then 1 end) as exact, count(case when x > 0 and abs(o - x) <= 0.1 * x then 1 end) as within_10, count(case when x > 0 and abs(o - x) <= 0.2 * x then 1 end) as within_20, count(case when x > 0 and o = 0 then 1 end) as missed, count(case when x = 0 and o > 0 then 1 end) as false_features from b""")
def a22_count_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.count_agreement(*_two(Fixtures(spark, sf_dir)), "gene_id").withColumn("correlation", F.round("correlation", 6))


@query(f"""with {_TWO} select case when 100.0 * o.count / x.count >= 200 then 200 else cast(floor(100.0 * o.count / x.count / 10) * 10 as bigint) end as bin, count(*) as n from o join x using (gene_id) group by 1""")
def a23_deviation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.deviation_histogram(*_two(Fixtures(spark, sf_dir)), "gene_id")


@query("""
with p as (select distinct gene_id, gene_id * 1500 + q * 20 as pos from fx_aln where not is_secondary), t as (select gene_id, e as pos from fx_exons group by gene_id, e),
n as (select p.gene_id, p.pos, t.pos as site, abs(p.pos - t.pos) as d, row_number() over (partition by p.gene_id, p.pos order by abs(p.pos - t.pos), t.pos) as k from p left join t on p.gene_id = t.gene_id)
select gene_id, pos, case when d <= 40 then site end as site, case when d <= 40 then d end as distance from n where k = 1""")
def a24_nearest_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted sites with the nearest true one."""
    x = Fixtures(spark, sf_dir)
    p = x.alignments().where("not is_secondary").select("gene_id", (F.col("gene_id") * 1500 + F.col("q") * 20).alias("pos")).distinct()
    return V.nearest_sites(p, x.exons().select("gene_id", F.col("e").alias("pos")).distinct(), ["gene_id"], 40).select("gene_id", "pos", "site", "distance")


@query("""with t as (select tx_id, gene_id, sum(e - s + 1) as len, count(*) as n from fx_exons group by tx_id, gene_id), i as (select gene_id, count(*) as n_introns from fx_introns group by gene_id)
select t.gene_id, count(*) as n_transcripts, cast(sum(n) as bigint) as n_exons, max(n_introns) as n_introns, round(avg(len), 4) as mean_length from t join i on t.gene_id = i.gene_id group by t.gene_id""")
def a25_annotation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.annotation_stats(Fixtures(spark, sf_dir).transcripts()).select("gene_id", "n_transcripts", "n_exons", "n_introns", F.round("mean_length", 4).alias("mean_length"))


@query(f"""with {_AGG}, a as (select gene_a, gene_b from c where support >= 2), b as (select gene_a, gene_b from c where support <= 2), n as (select count(case when a.gene_a is not null and b.gene_a is not null then 1 end) as tp, count(case when b.gene_a is null then 1 end) as fp, count(case when a.gene_a is null then 1 end) as fn from a full join b on a.gene_a = b.gene_a and a.gene_b = b.gene_b)
select tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall from n""".replace("n as (select gene, count(*) as n from (select gene_a as gene from c union all select gene_b from c) group by gene), ", ""))
def a21_pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.aggregate(_pairs(Fixtures(spark, sf_dir)))
    return X.agreement(c.where("support >= 2"), c.where("support <= 2")).select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


# ---------------------------------------------------------------- graph


@query("select chr, s, e, count(*) as n from fx_read_introns i join fx_aln a using (aln_id) where not is_secondary group by chr, s, e")
def g1_intron_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Fixtures(spark, sf_dir)
    return G.count_introns(x.read_introns().join(x.alignments().where("not is_secondary").select("aln_id"), "aln_id"))


@query("""with o as (select aln_id, chr, s, e, lead(s) over (partition by aln_id order by s) as ns, lead(e) over (partition by aln_id order by s) as ne from fx_read_introns) select chr, s, e, ns, ne, count(*) as weight from o where ns is not null group by chr, s, e, ns, ne""")
def g3_intron_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges of consecutive introns."""
    return G.intron_edges(Fixtures(spark, sf_dir).reads())


@query()
def g2_intron_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each intron with the one that stands for it (known ones, then frequent ones); greedy, so tested on cases and by g2_invariant."""
    x = Fixtures(spark, sf_dir)
    return G.cluster_introns(G.count_introns(x.read_introns()), x.introns().select("chr", "s", "e").distinct(), 6, 2)


@query("select cast(0 as bigint) as far, cast(0 as bigint) as known_moved")
def g2_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every intron is within delta of its representative, and known ones stand for themselves."""
    c = g2_intron_clusters(spark, sf_dir)
    return c.agg(F.count_if((F.col("rep_s").isNotNull()) & ((F.abs(F.col("s") - F.col("rep_s")) > 6) | (F.abs(F.col("e") - F.col("rep_e")) > 6))).alias("far"), F.count_if(F.col("known") & ((F.col("s") != F.col("rep_s")) | (F.col("e") != F.col("rep_e")))).alias("known_moved"))


@query("""with i as (select distinct gene_id, chr, s, e from fx_introns) select gene_id, chr, min(s) as comp_s, max(e) as comp_e, count(*) as n_introns from i group by gene_id, chr""")
def g8_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the intron graph of the annotation: those of one gene hang together through its full-length transcript."""
    x = Fixtures(spark, sf_dir)
    comps = G.graph_components(x.transcripts())
    rows = x.introns().select("gene_id", "chr", "s", "e").distinct().join(comps, ["chr", "s", "e"])
    return rows.groupBy("gene_id", "chr", "component").agg(F.min("s").alias("comp_s"), F.max("e").alias("comp_e"), F.count("*").alias("n_introns")).drop("component")


@query("""with f as (select r.aln_id, r.gene_id, r.chr, string_agg(cast(i.s as varchar) || '-' || cast(i.e as varchar), ',' order by i.s) as chain from fx_reads r join fx_read_introns i using (aln_id) group by r.aln_id, r.gene_id, r.chr),
t as (select tx_id, gene_id, string_agg(cast(s as varchar) || '-' || cast(e as varchar), ',' order by s) as chain from fx_introns group by tx_id, gene_id), k as (select distinct gene_id, s, e from fx_introns),
c as (select gene_id, chr, chain, count(*) as n from f group by gene_id, chr, chain having count(*) >= 3),
p as (select c.gene_id, c.chain, bool_and(exists (select 1 from k where k.gene_id = c.gene_id and cast(k.s as varchar) || '-' || cast(k.e as varchar) = u.x)) as all_known from (select gene_id, chain, unnest(string_split(chain, ',')) as x from c) u join c on c.gene_id = u.gene_id and c.chain = u.chain group by c.gene_id, c.chain)
select c.gene_id, c.chr, c.chain, c.n, case when exists (select 1 from t where t.gene_id = c.gene_id and t.chain = c.chain) then 'known' when p.all_known then 'NIC' else 'NNIC' end as kind from c join p on c.gene_id = p.gene_id and c.chain = p.chain""")
def g10_full_length_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intron chains with enough reads: known, new combinations of known introns, or with new introns."""
    x = Fixtures(spark, sf_dir)
    return G.chain_models(x.reads(), x.transcripts(), 3)


@query("""with c as (select r.gene_id, i.s, i.e, count(*) as n from fx_read_introns i join fx_reads r using (aln_id) group by r.gene_id, i.s, i.e), k as (select distinct gene_id as ref, chr, s, e from fx_introns),
m as (select c.gene_id, k.ref, count(*) as shared from c join k on c.s = k.s and c.e = k.e and k.chr = 'chr' || cast(c.gene_id % 5 as varchar) group by c.gene_id, k.ref), r as (select *, row_number() over (partition by gene_id order by shared desc, ref desc) as n from m) select gene_id, ref, shared from r where n = 1""")
def g19_reference_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated gene with most shared introns, the largest id on ties."""
    x = Fixtures(spark, sf_dir)
    models = x.read_introns().select("gene_id", "chr", "s", "e").distinct()
    return G.reference_gene(models, x.introns().select(F.col("gene_id").alias("ref"), "chr", "s", "e").distinct(), "gene_id")


@query("""with d as (select gene_id, jit as gap, count(*) as n from fx_aln where jit <> 0 group by gene_id, jit), r as (select *, row_number() over (partition by gene_id order by n desc, gap) as k, sum(n) over (partition by gene_id) as total from d) select gene_id, gap, n, cast(total as bigint) as total from r where k = 1 and n >= 5""")
def g14_site_shift_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent shift of reads at a splice site, if enough reads agree."""
    rows = Fixtures(spark, sf_dir).alignments().where("jit != 0").select("gene_id", F.col("jit").alias("gap"))
    return G.shift_mode(rows, ["gene_id"], "gap", 5)


@query("""select tx_id, s, e, 'annotation' as origin from fx_exons union all select 1000000 + gene_id, min(s), max(e), 'model' from fx_reads where n_blocks = 2 group by gene_id""")
def g22_extended_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation plus new models."""
    x = Fixtures(spark, sf_dir)
    models = x.reads().where("n_blocks = 2").groupBy("gene_id").agg(F.min("s").alias("s"), F.max("e").alias("e")).select((F.col("gene_id") + 1000000).alias("tx_id"), "s", "e")
    return x.exons().select("tx_id", "s", "e", F.lit("annotation").alias("origin")).unionByName(models.withColumn("origin", F.lit("model")))


@query()
def g18_gene_joining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models joined into genes: a shared intron or half overlap on one strand; two annotated genes never meet."""
    x = Fixtures(spark, sf_dir)
    return G.join_genes(x.transcripts().withColumn("annotated", F.when(F.col("tx_id") % 4 == 0, F.col("gene_id"))))
