"""Queries: sources, tails and motifs, ends of models, retention, what counts, remaining tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import alignments as A
from ..operators import classify as K
from ..operators import counting as C
from ..operators import discovery as G
from ..operators import evaluation as V
from ..operators import fusion as X
from ..sources import readers, sinks
from .fixtures import Fixtures
from .q_counting import _KIND_SQL, _typed
from .registry import query

text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")

# ---------------------------------------------------------------- sources


@query("select file_group, count(*) as n, min(s) as first_s, max(e) as last_e from (select case when strand = '+' then 0 else 1 end as file_group, s, e from fx_reads) group by file_group")
def s1_merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of two files as one table, sorted in ranges; the file number is kept."""
    r = Fixtures(spark, sf_dir).reads().select("aln_id", "chr", "strand", "s", "e")
    merged = readers.merge_sources([r.where("strand = '+'"), r.where("strand = '-'")])
    return merged.groupBy(F.col("file_group").alias("file_group")).agg(F.count("*").alias("n"), F.min("s").alias("first_s"), F.max("e").alias("last_e"))


@query("select aln_id, string_agg(cast(s as varchar) || '-' || cast(e as varchar), ',' order by s) as blocks from (select aln_id, s + case when rnk = lo then 0 else 4 end as s, e from (select *, min(rnk) over (partition by aln_id) as lo from fx_blocks)) group by aln_id")
def s4_joined_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that begin and end with a match: a deletion behind an intron belongs to none; insertions split nothing."""
    x = Fixtures(spark, sf_dir).reads()
    part = F.transform("blocks", lambda b, i: F.concat(
        F.when(i > 0, F.concat((b["s"] - F.get("blocks", i - 1)["e"] - 1).cast("string"), F.lit("N4D"), (b["e"] - b["s"] - 13).cast("string"), F.lit("M2I10M"))).otherwise(F.concat((b["e"] - b["s"] - 9).cast("string"), F.lit("M2I10M")))))
    rows = x.select("aln_id", F.col("s").alias("pos"), F.concat(F.lit("3S"), F.array_join(part, "")).alias("cigar"))
    return rows.select("aln_id", I.blocks_to_text(readers.joined_blocks(F.col("pos"), F.col("cigar"))).alias("blocks"))


@query("""with t as (select distinct chr, min(s) as s, max(e) as e, strand, 't' || (gene_id % 40) as transcript_id from fx_exons group by gene_id, chr, strand), n as (select *, row_number() over (partition by transcript_id order by chr, s, e, strand) - 1 as k from t)
select chr, s, e, strand, transcript_id, case when k > 0 then transcript_id || '.' || k else transcript_id end as new_transcript_id from n""")
def s6_renamed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript ids that occur at several places, told apart."""
    g = Fixtures(spark, sf_dir).genes().select("chr", "s", "e", "strand", F.concat(F.lit("t"), text(F.col("gene_id") % 40)).alias("transcript_id"), F.lit("transcript").alias("feature"))
    return readers.rename_duplicates(g)


@query("select aln_id, chr || ':' || barcode as barcode, umi from fx_aln join fx_reads using (aln_id) where q % 4 <> 0 union all select aln_id, null, null from fx_aln join fx_reads using (aln_id) where q % 4 = 0")
def s13_barcodes_of_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode and UMI out of tags, without the suffix of the barcode."""
    x = Fixtures(spark, sf_dir)
    rows = x.reads().select("aln_id", "chr").join(x.alignments().select("aln_id", "barcode", "umi", "q"), "aln_id")
    tags = F.when(F.col("q") % 4 == 0, F.create_map(F.lit("XX"), F.lit("1"))).otherwise(F.create_map(F.lit("CB"), F.concat(F.col("chr"), F.lit(":"), F.col("barcode"), F.lit("-1")), F.lit("UB"), F.col("umi")))
    return readers.barcode_tags(rows.withColumn("tags", tags).drop("barcode", "umi")).select("aln_id", "barcode", "umi")


@query("select chr, s, e, count(*) as n from fx_read_introns group by chr, s, e")
def s14_short_read_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns of alignments with their counts."""
    x = Fixtures(spark, sf_dir).reads()
    part = F.transform("blocks", lambda b, i: F.concat(F.when(i > 0, F.concat((b["s"] - F.get("blocks", i - 1)["e"] - 1).cast("string"), F.lit("N"))).otherwise(""), (b["e"] - b["s"] + 1).cast("string"), F.lit("M")))
    return readers.short_read_introns(x.select("chr", F.col("s").alias("pos"), F.array_join(part, "").alias("cigar")))


@query("""with f as (select aln_id, r.chr, r.strand, case when strand = '+' then s else e end as five from fx_reads r), p as (select chr, strand, case when strand = '+' then min(s) + 15 else max(e) - 15 end as s from fx_exons group by tx_id, chr, strand)
select distinct f.aln_id, p.s as rs, p.s + 10 as re from f join p on f.chr = p.chr and f.strand = p.strand and f.five - 5 <= p.s + 10 and p.s <= f.five + 5""")
def s15_cage_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of starts about the 5' ends of reads."""
    x = Fixtures(spark, sf_dir)
    reads = x.reads().select("aln_id", "chr", "strand", F.when(F.col("strand") == "+", F.col("s")).otherwise(F.col("e")).alias("five_prime"))
    p = x.transcripts().select("chr", "strand", F.when(F.col("strand") == "+", F.col("span.s") + 15).otherwise(F.col("span.e") - 15).alias("s")).select("chr", "strand", "s", (F.col("s") + 10).alias("e")).distinct()
    return A.cage_hits(reads, p)


# ---------------------------------------------------------------- tails, motifs, strands

_TAILS = "select aln_id, strand, s, e, n_blocks, case when q % 3 = 0 then e end as polya, case when q % 5 = 0 then s end as polyt, q from fx_reads join fx_aln using (aln_id)"


def _tails(x: Fixtures) -> DataFrame:
    r = x.reads().join(x.alignments().select("aln_id", "q"), "aln_id")
    return r.withColumn("polya", F.when(F.col("q") % 3 == 0, F.col("e"))).withColumn("polyt", F.when(F.col("q") % 5 == 0, F.col("s")))


@query(f"select aln_id, coalesce(polya, case when strand = '+' then e end) as polya, coalesce(polyt, case when strand = '-' then s end) as polyt from ({_TAILS})")
def p12_artificial_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.artificial_tail(_tails(Fixtures(spark, sf_dir))).select("aln_id", "polya", "polyt")


@query("""with i as (select tx_id, s, e, case (s % 7) when 0 then 'GT' when 1 then 'GC' when 2 then 'CT' when 3 then 'AT' else 'AA' end as l, case (s % 7) when 0 then 'AG' when 1 then 'AG' when 2 then 'AC' when 3 then 'AC' else 'TT' end as r from fx_introns),
c as (select tx_id, count(case when l || '-' || r in ('GT-AG', 'GC-AG', 'AT-AC') then 1 end) as f, count(case when l || '-' || r in ('CT-AC', 'CT-GC', 'GT-AT') then 1 end) as b, count(*) as n from i group by tx_id)
select tx_id, case when f > b then '+' when b > f then '-' when tx_id % 2 = 0 then '+' else '.' end as strand, f = n as all_forward from c""")
def p13_splice_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strand by the motifs of introns, a tail on ties; whether all are canonical on +."""
    t = Fixtures(spark, sf_dir).transcripts().where(F.size("introns") > 0)
    left = lambda i: F.element_at(F.array(*map(F.lit, ("GT", "GC", "CT", "AT", "AA", "AA", "AA"))), (i["s"] % 7 + 1).cast("int"))
    right = lambda i: F.element_at(F.array(*map(F.lit, ("AG", "AG", "AC", "AC", "TT", "TT", "TT"))), (i["s"] % 7 + 1).cast("int"))
    pieces = F.transform("introns", lambda i, k: F.concat(F.repeat(F.lit("N"), (i["s"] - F.when(k == 0, F.col("span.s")).otherwise(F.get("introns", k - 1)["e"] + 1)).cast("int")), left(i), F.repeat(F.lit("N"), (i["e"] - i["s"] - 3).cast("int")), right(i)))
    t = t.withColumn("seq", F.array_join(pieces, "")).withColumn("polya", F.when(F.col("tx_id") % 2 == 0, F.lit(1)))
    found = A.splice_strand(F.col("introns"), F.col("seq"), F.col("span.s"), F.col("polya"), F.lit(None).cast("int"))
    return t.select("tx_id", found.alias("strand"), A.all_canonical(F.col("introns"), F.col("seq"), F.col("span.s"), F.lit("+")).alias("all_forward"))


@query(f"with t as ({_KIND_SQL}) select t.aln_id, case when assignment_type like 'unique%' then r.strand when t.n_blocks = 1 then case when polya_found then '+' else '.' end else 'm' end as strand from t join fx_reads r using (aln_id)")
def p14_assignment_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Fixtures(spark, sf_dir)
    rows = _typed(x).join(x.reads().select("aln_id", "strand"), "aln_id")
    return rows.select("aln_id", A.assignment_strand(F.col("assignment_type"), F.col("strand"), F.col("n_blocks"), F.when(F.col("polya_found"), "+"), F.lit("m")).alias("strand"))


@query("select umi, round(cast(length(umi) - length(replace(umi, 'A', '')) as double) / length(umi), 6) as share from (select distinct umi from fx_aln)")
def p16_downstream_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = Fixtures(spark, sf_dir).alignments().select("umi").distinct()
    return u.select("umi", F.round(A.downstream_a_share(F.col("umi")), 6).alias("share"))


@query("select aln_id, len(list_filter([s - 20, s + 3, s + 13, s + 40], lambda d: abs(d - s) <= 14)) as near from fx_reads")
def p19_boundary_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Fixtures(spark, sf_dir).reads()
    d = F.array(*[F.struct((F.col("s") + k).alias("pos"), F.lit(3).alias("len")) for k in (-20, 3, 13, 40)])
    return r.select("aln_id", F.size(G.boundary_deletions(d, F.col("s"))).cast("long").alias("near"))


# ---------------------------------------------------------------- what counts


@query(f"with t as ({_KIND_SQL}) select aln_id from t where not (assignment_type like 'inconsistent%' and mapq < 5)")
def f3_poor_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_poor_inconsistent(_typed(Fixtures(spark, sf_dir))).select("aln_id")


@query(f"with t as ({_KIND_SQL}) select aln_id, polya_found as with_tail from t where assignment_type in ('unique', 'unique_minor_difference', 'ambiguous', 'inconsistent_non_intronic') and (polya_found or file_group % 2 = 0)")
def f7_stranded_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that terminal counters take, from files of which every other one is stranded."""
    rows = _typed(Fixtures(spark, sf_dir))
    kind, tail = F.col("assignment_type"), F.col("polya_found")
    return rows.where(F.when(F.col("file_group") % 2 == 0, C.counts_for_ends(kind, tail, True)).otherwise(C.counts_for_ends(kind, tail))).select("aln_id", F.col("polya_found").alias("with_tail"))


@query(f"with t as ({_KIND_SQL}) select aln_id from t where assignment_type not in ('noninformative', 'ambiguous')")
def f11_gene_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(Fixtures(spark, sf_dir)).where(C.counts_for_genes(F.col("assignment_type"))).select("aln_id")




@query("""with k as (select tx_id, gene_id, s, e, row_number() over (partition by tx_id order by s) as k, count(*) over (partition by tx_id) as n from fx_introns)
select k.gene_id, k.s, k.e, count(*) as retained from fx_aln a join k on k.tx_id = a.src_tx and k.k = 2 and k.n = 3 where a.q % 3 = 0 and a.q between 10 and 40 and a.ln <> 7 group by k.gene_id, k.s, k.e""")
def a8_retained_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns that reads retain by their events against the transcript they come from; every third read has its second intron filled."""
    x = Fixtures(spark, sf_dir)
    tx = x.transcripts().select(F.col("tx_id").alias("src_tx"), "exons", F.col("introns").alias("tx_introns"), F.col("span").alias("tx_span"))
    rows = x.reads().join(x.alignments().select("aln_id", "q", "ln"), "aln_id").join(tx, "src_tx").where("q % 3 = 0 and q between 10 and 40 and ln != 7 and size(tx_introns) = 3")
    filled = F.array(F.col("introns")[0], F.col("introns")[2])
    found = K.with_events(rows.withColumn("introns", filled).withColumn("known", F.col("tx_introns")).drop("blocks"))
    return C.retained_introns(found.withColumn("gene_assignment_type", F.lit("inconsistent")), ["gene_id"])


# ---------------------------------------------------------------- models and ends


@query("""with m as (select tx_id, strand, arg_max(s, rnk) as ls, arg_max(e, rnk) as le, arg_min(s, rnk) as fs, arg_min(e, rnk) as fe from fx_exons group by tx_id, strand),
p as (select tx_id, strand, case when strand = '-' then fs + 10 * k else le - 10 * k end as site, cast((tx_id * k) % 9 + 1 as bigint) as reads from m cross join (values (3), (6), (9), (20)) as v(k)),
t as (select *, max(reads) over (partition by tx_id) as top from p)
select t.tx_id, site, reads from t join m using (tx_id) where case when t.strand = '-' then site between fs and fe and abs(site - fs) > 50 else site between ls and le and abs(site - le) > 50 end and reads >= greatest(3, 0.05 * top)""")
def g15_alternative_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks inside the terminal exon of either strand that give a sibling model."""
    t = Fixtures(spark, sf_dir).transcripts().select("tx_id", "strand", "exons")
    first, last = F.element_at("exons", 1), F.element_at("exons", -1)
    peaks = t.withColumn("k", F.explode(F.array(*map(F.lit, (3, 6, 9, 20))))).select("tx_id", F.when(F.col("strand") == "-", first["s"] + 10 * F.col("k")).otherwise(last["e"] - 10 * F.col("k")).alias("site"), ((F.col("tx_id") * F.col("k")) % 9 + 1).alias("reads"))
    return G.alternative_ends(t, peaks).select("tx_id", "site", "reads")


@query("""with r as (select aln_id, src_tx, e from fx_reads where e % 2 = 0), m as (select tx_id, max(e) as site from fx_exons group by tx_id), z as (select tx_id, site from m union select tx_id, site - 60 from m where tx_id % 2 = 0)
select r.aln_id as read_id, z.tx_id, arg_min(z.site, (abs(z.site - r.e), z.site)) as site from r join z on z.tx_id = r.src_tx group by r.aln_id, z.tx_id""")
def g15_reads_of_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read with the nearest end of its model and the model's siblings."""
    x = Fixtures(spark, sf_dir)
    m = x.exons().groupBy("tx_id").agg(F.max("e").alias("site"))
    return G.deal_to_ends(x.reads().where("e % 2 = 0").select(F.col("aln_id").alias("read_id"), F.col("src_tx").alias("tx_id"), F.col("e").alias("end")), m, m.where("tx_id % 2 = 0").withColumn("site", F.col("site") - 60))


_GRAPH_SQL = """v as (select chr, s, e, case when s % 11 = 0 then 1 else count(*) end as n from fx_read_introns group by chr, s, e),
ed as (select chr, s, e, ns, ne from (select chr, s, e, lead(s) over (partition by aln_id order by s) as ns, lead(e) over (partition by aln_id order by s) as ne from fx_read_introns) where ns is not null group by chr, s, e, ns, ne)"""


def _graph(x: Fixtures) -> tuple[DataFrame, DataFrame]:
    introns = x.read_introns()
    return introns.groupBy("chr", "s", "e").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("s") % 11 == 0, 1).otherwise(F.col("n"))), G.intron_edges(x.reads()).drop("weight")


@query(f"""with {_GRAPH_SQL}, sides as (select chr, s, e, ns as ks, ne as ke, 1 as side from ed union all select chr, ns, ne, s, e, 0 from ed),
p as (select a.chr, a.s, a.e, b.s as ts, b.e as te, v.n, w.n as tn from sides a join sides b on a.chr = b.chr and a.ks = b.ks and a.ke = b.ke and a.side = b.side join v on v.chr = a.chr and v.s = a.s and v.e = a.e join v w on w.chr = b.chr and w.s = b.s and w.e = b.e
  where abs(a.s - b.s) <= 20 and abs(a.e - b.e) <= 20 and (a.s <> b.s or a.e <> b.e) and v.n < w.n * 0.5), r as (select distinct * from p), k as (select *, row_number() over (partition by chr, s, e order by tn desc, ts desc, te desc) as k from r)
select chr, s, e, ts as to_s, te as to_e from k where k = 1""")
def g4_collapsed_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak introns that give way to a strong one next to them."""
    return G.collapse_tips(*_graph(Fixtures(spark, sf_dir)))


@query(f"""with {_GRAPH_SQL}, o as (select chr, s, e, count(*) as k from ed group by chr, s, e), i as (select chr, ns as s, ne as e, count(*) as k from ed group by chr, ns, ne),
f as (select ed.chr, ed.s as fs, ed.e as fe, ed.ns as s, ed.ne as e, v.n = 1 and o.k is null as dead from ed join v on v.chr = ed.chr and v.s = ed.ns and v.e = ed.ne left join o on o.chr = ed.chr and o.s = ed.ns and o.e = ed.ne),
b as (select ed.chr, ed.ns as fs, ed.ne as fe, ed.s, ed.e, v.n = 1 and i.k is null as dead from ed join v on v.chr = ed.chr and v.s = ed.s and v.e = ed.e left join i on i.chr = ed.chr and i.s = ed.s and i.e = ed.e),
u as (select *, bool_and(dead) over (partition by chr, fs, fe) as whole from f union all select *, bool_and(dead) over (partition by chr, fs, fe) from b)
select distinct u.chr, u.s, u.e from u join v on v.chr = u.chr and v.s = u.fs and v.e = u.fe where whole and v.n >= 3""")
def g5_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-read introns that lead nowhere, behind well covered ones."""
    return G.dead_ends(*_graph(Fixtures(spark, sf_dir)), least=3)


@query("""with m as (select src_tx as tx_id, count(*) as reads, max(mapq) / 60.0 as coverage, max(n) as n_exons from fx_aln join (select tx_id, case when tx_id % 5 = 0 then 1 else count(*) end as n from fx_exons group by tx_id) x on x.tx_id = src_tx group by src_tx)
select tx_id, reads from m where reads >= 20 and (n_exons > 1 or coverage >= 0.75)""")
def g11_coverage_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known transcripts with enough consistent reads, unspliced ones with enough coverage too."""
    x = Fixtures(spark, sf_dir)
    n = x.transcripts().select(F.col("tx_id").alias("src_tx"), F.when(F.col("tx_id") % 5 == 0, 1).otherwise(F.col("n_exons")).alias("n_exons"))
    rows = x.alignments().join(n, "src_tx").select(F.col("src_tx").alias("tx_id"), (F.col("mapq") / 60.0).alias("coverage"), "n_exons")
    return G.coverage_models(rows, 20).select("tx_id", "reads")


@query("""with r as (select aln_id as read_id, case when q % 4 = 0 then null else 'm' || (src_tx + k) end as model, q % 3 <> 0 as consistent from fx_aln cross join (values (0), (1)) as v(k) where k = 0 or q % 2 = 1),
c as (select *, count(model) over (partition by read_id) as n from r)
select category, count(*) as n, round(cast(sum(w) as double), 4) as weight from (select case when model is null then 'unassigned' when not consistent then 'rejected' when n = 1 then 'unique' else 'shared' end as category, case when model is null or not consistent then 0.0 when n = 1 then 1.0 else 1.0 / n end as w from c) group by category""")
def g20_read_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of models by category, and what they weigh."""
    x = Fixtures(spark, sf_dir).alignments()
    rows = x.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where("k = 0 or q % 2 = 1").select(F.col("aln_id").alias("read_id"), F.when(F.col("q") % 4 != 0, F.concat(F.lit("m"), text(F.col("src_tx") + F.col("k")))).alias("model"), (F.col("q") % 3 != 0).alias("consistent"))
    return G.read_categories(rows).groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query()
def g12_novel_mono_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unspliced reads with tails as models; clusters are greedy, tested on cases."""
    r = Fixtures(spark, sf_dir).reads()
    return G.novel_mono_exons(r.select("chr", "strand", F.slice("blocks", 1, 1).alias("blocks"), F.col("blocks")[0].alias("span"), F.col("blocks")[0]["e"].alias("tail")))


# ---------------------------------------------------------------- fusions, evaluation


@query("""select name, count(*) as n from (select case when s is null or regexp_matches(s, '^(ENSG[0-9]|RP[0-9]+-)') then 'intergenic' else s end as name from (select regexp_replace(case c_custkey % 5 when 0 then 'GENE' || c_nationkey || '-AS1' when 1 then 'ENSG0' || c_custkey when 2 then 'RP11-' || c_custkey when 3 then 'G-DT' else 'SYM' || c_nationkey end, '-(AS|IT|OT|DT)[0-9]*$', '') as s from customer)) group by name""")
def x5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of genes as the fusion report has them."""
    k, n = F.col("c_custkey"), text("c_nationkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("GENE"), n, F.lit("-AS1"))).when(k % 5 == 1, F.concat(F.lit("ENSG0"), text(k))).when(k % 5 == 2, F.concat(F.lit("RP11-"), text(k))).when(k % 5 == 3, "G-DT").otherwise(F.concat(F.lit("SYM"), n))
    return Fixtures(spark, sf_dir).table("customer").select(X.label(raw).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("""with c as (select 'G' || (gene_id % 6) as gene_a, 'H' as gene_b, 'chr1' as chr_a, 'chr2' as chr_b, gene_id * 60 as consensus_a, (q % 5) * 120 as consensus_b, count(*) as support from fx_aln group by all),
a as (select *, sum(case when consensus_a - pa <= 100 then 0 else 1 end) over (partition by gene_a order by consensus_a, consensus_b rows unbounded preceding) as ga from (select *, lag(consensus_a) over (partition by gene_a order by consensus_a, consensus_b) as pa from c)),
b as (select *, sum(case when consensus_b - pb <= 100 then 0 else 1 end) over (partition by gene_a, ga order by consensus_b, consensus_a rows unbounded preceding) as gb from (select *, lag(consensus_b) over (partition by gene_a, ga order by consensus_b, consensus_a) as pb from a))
select gene_a, cast(sum(support) as bigint) as support, count(*) as merged from b group by gene_a, ga, gb""")
def x11_merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the same genes with near breakpoints."""
    x = Fixtures(spark, sf_dir).alignments()
    c = x.groupBy(F.concat(F.lit("G"), text(F.col("gene_id") % 6)).alias("gene_a"), F.lit("H").alias("gene_b"), F.lit("chr1").alias("chr_a"), F.lit("chr2").alias("chr_b"), (F.col("gene_id") * 60).alias("consensus_a"), (F.col("q") % 5 * 120).alias("consensus_b")).agg(F.count("*").alias("support"))
    return X.merge_identical(c).select("gene_a", "support", "merged")


@query("""select 'exon' as kind, e - s + 1 as length, count(*) as n from (select distinct chr, strand, s, e from fx_exons) group by length union all select 'intron', e - s + 1 as length, count(*) from (select distinct chr, strand, s, e from fx_introns) group by length
union all select 'transcript', cast(l as bigint), count(*) from (select sum(e - s + 1) as l from fx_exons group by tx_id) group by l""")
def a25_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lengths(Fixtures(spark, sf_dir).transcripts())


@query("""with i as (select strand, case s % 3 when 0 then 'GTAAG' when 1 then 'CTTTT' else 'ATCCC' end as l, case s % 3 when 0 then 'TTTAG' when 1 then 'GGGAC' else 'CCCAC' end as r from fx_introns)
select case when strand = '-' then reverse(translate(substr(r, 4, 2), 'ACGT', 'TGCA')) || '-' || reverse(translate(substr(l, 1, 2), 'ACGT', 'TGCA')) else substr(l, 1, 2) || '-' || substr(r, 4, 2) end as motif, count(*) as n from i group by motif""")
def a25_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last bases of introns on their strand."""
    i, k = Fixtures(spark, sf_dir).introns(), F.col("s") % 3
    return V.motif_counts(i.select("strand", F.when(k == 0, "GTAAG").when(k == 1, "CTTTT").otherwise("ATCCC").alias("left"), F.when(k == 0, "TTTAG").when(k == 1, "GGGAC").otherwise("CCCAC").alias("right")))


# ---------------------------------------------------------------- tables, profiles


@query("""select read_id, chr, strand, cast(gene_id as varchar) as gene_id, 'unique' as gene_assignment_type, cast(src_tx as varchar) as isoform_id, 'fsm,intron_shift' as assignment_events, '.' as classification, b.exons, barcode, '.' as groups
from fx_aln a join (select aln_id, chr, strand, string_agg(s || '-' || e, ',' order by s) as exons from fx_blocks group by aln_id, chr, strand) b using (aln_id)""")
def k1_read_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the table of reads."""
    x = Fixtures(spark, sf_dir)
    rows = x.reads().join(x.alignments().select("aln_id", "barcode"), "aln_id").withColumn("tx_id", F.col("src_tx")).withColumn("gene_assignment_type", F.lit("unique")).withColumn("events", F.array(F.struct(F.lit("fsm").alias("event")), F.struct(F.lit("intron_shift").alias("event"))))
    return sinks.read_info(rows).select("read_id", "chr", "strand", "gene_id", "gene_assignment_type", "isoform_id", "assignment_events", "classification", "exons", "barcode", "groups")


@query("""select read_id, cast(a.gene_id as varchar) as gene_id, cell_type, barcode, umi, coalesce(i.introns, '') as introns, b.exons from fx_aln a join (select aln_id, ';%;' || string_agg(chr || '_' || s || '_' || e || '_' || strand, ';%;' order by s) as exons from fx_blocks group by aln_id) b using (aln_id)
left join (select aln_id, ';%;' || string_agg(chr || '_' || s || '_' || e || '_' || strand, ';%;' order by s) as introns from fx_read_introns group by aln_id) i using (aln_id)""")
def k10_allinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of molecules."""
    x = Fixtures(spark, sf_dir)
    rows = x.reads().join(x.alignments().select("aln_id", "cell_type", "barcode", "umi"), "aln_id").withColumn("gene_id", text("gene_id"))
    return sinks.allinfo(rows).select("read_id", "gene_id", "cell_type", "barcode", "umi", "introns", "exons")


@query("""select gene_id, cell_type, cast(count(case when q % 2 = 0 then 1 end) as varchar) || ',' || cast(count(case when q % 2 = 1 then 1 end) as varchar) as cell from fx_aln group by gene_id, cell_type""")
def k8_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells "included,excluded", long again."""
    c = Fixtures(spark, sf_dir).alignments().groupBy("gene_id", "cell_type").agg(F.count_if(F.col("q") % 2 == 0).alias("include_counts"), F.count_if(F.col("q") % 2 == 1).alias("exclude_counts"))
    kinds = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = C.include_exclude_cells(c, ["gene_id"], "cell_type", kinds)
    return wide.unpivot(["gene_id"], kinds, "cell_type", "cell").where("cell != '0,0'")


@query("""with f as (select distinct gene_id, s, e from fx_introns), m as (select r.aln_id, r.gene_id, f.s, f.e, exists (select 1 from fx_read_introns i where i.aln_id = r.aln_id and abs(i.s - f.s) <= 6 and abs(i.e - f.e) <= 6) as p, exists (select 1 from fx_introns t where t.tx_id = r.src_tx and t.s = f.s and t.e = f.e) as t from fx_reads r join f using (gene_id))
select aln_id, coalesce(string_agg(s || '-' || e, ',' order by s, e) filter (p and t), '') as shared, (select min(abs(r.s - x.s)) from fx_exons x, fx_reads r where r.aln_id = m.aln_id and x.gene_id = r.gene_id) as nearest from m group by aln_id""")
def i20_masked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that a read shows and its transcript has, and the distance to the nearest exon start."""
    x = Fixtures(spark, sf_dir)
    features = x.introns().groupBy("gene_id").agg(F.array_sort(F.collect_set(I.iv("s", "e"))).alias("features"))
    starts = x.exons().groupBy("gene_id").agg(F.collect_set("s").alias("starts"))
    own = x.transcripts().select(F.col("tx_id").alias("src_tx"), F.col("introns").alias("tx_introns"))
    r = x.reads().join(features, "gene_id").join(starts, "gene_id").join(own, "src_tx")
    read = F.transform("features", lambda f: F.when(F.exists("introns", lambda i: I.equal_ranges(i, f, 6)), 1).otherwise(-1))
    truth = F.transform("features", lambda f: F.when(F.array_contains("tx_introns", f), 1).otherwise(-1))
    return r.select("aln_id", I.blocks_to_text(I.blocks_of_profile(F.col("features"), I.mask_profile(read, truth))).alias("shared"), F.abs(I.closest(F.col("starts"), F.col("s")) - F.col("s")).alias("nearest"))
