"""Queries: lookups, conversions, molecules to reads, fusion gates, tables of assignments, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import counting as C
from ..operators import dedup as D
from ..operators import fusion as X
from ..operators import lookups as L
from ..operators import models as G
from ..sources import sinks
from .fixtures import Fixtures
from .q_counting import _KIND_SQL, _typed
from .registry import query

# ---------------------------------------------------------------- lookups


@query("""with t as (select read_id, min({'barcode': barcode, 'umi': umi}) as b from fx_aln where ln < 4 group by read_id)
select a.aln_id, t.b.barcode as barcode, t.b.umi as umi from fx_aln a left join t using (read_id)""")
def j9_read_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode and UMI of reads from a table that has some of them."""
    x = Fixtures(spark, sf_dir).alignments()
    return L.with_barcodes(x.select("aln_id", "read_id"), x.where("ln < 4").select("read_id", "barcode", "umi")).select("aln_id", "barcode", "umi")


@query("select tx_id, 'unknown_type' as transcript_type, case when strand = '-' then min(s) - 1 else max(e) + 1 end as polya_site from fx_exons group by tx_id, strand")
def j10_transcript_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.transcript_sites(Fixtures(spark, sf_dir).transcripts())


_WIDE = "select gene_id, chr, s - case when gene_id % 3 = 0 then 6600 else 0 end as s, e from fx_genes"


@query(f"""with b as ({_WIDE}), m as (select *, coalesce(max(e) over (partition by chr order by s, e, gene_id rows between unbounded preceding and 1 preceding), -1) as reach from b),
g as (select *, sum(case when s > reach then 1 else 0 end) over (partition by chr order by s, e, gene_id rows unbounded preceding) as k from m)
select chr, min(s) as s, max(e) as e, string_agg(cast(gene_id as varchar), ',' order by gene_id) as genes, count(*) as n_blocks from g group by chr, k""")
def j14_merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene blocks that overlap, merged with their gene lists."""
    g = Fixtures(spark, sf_dir).genes()
    b = g.select("chr", (F.col("s") - F.when(F.col("gene_id") % 3 == 0, 6600).otherwise(0)).alias("s"), "e", F.array("gene_id").alias("genes"))
    return L.merge_blocks(b).select("chr", "s", "e", F.array_join(F.transform("genes", lambda v: v.cast("string")), ",").alias("genes"), "n_blocks")


@query("""with p as (select aln_id, 'chr' || cast(gene_id % 5 as varchar) as left_chr, 1000 + q + 100 - 1 as left_pos, [{'n': 1, 'chr': 'chrA', 'pos': 500 + q, 'mapq': mapq, 'len': q + 30}, {'n': 2, 'chr': 'chrB', 'pos': 900 + q + 80 - q - 1, 'mapq': 60 - mapq, 'len': 80 - q}] as x from fx_aln),
k as (select aln_id, left_chr, left_pos, unnest(list_filter(x, lambda v: v.len >= 40 and v.mapq >= 10)) as v from p)
select aln_id as read_id, row_number() over (partition by aln_id order by v.mapq desc, v.len desc, v.chr) - 1 as rank, left_chr, left_pos, v.chr as right_chr, v.pos as right_pos, v.mapq as right_mapq from k""")
def j18_linked_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of primary and supplementary ends by the tag; the first entry is clipped on the left, the second on the right."""
    x = Fixtures(spark, sf_dir).alignments()
    t = lambda c: c.cast("string")
    q, m = F.col("q"), F.col("mapq")
    sa = F.concat(F.lit("chrA,"), t(500 + q), F.lit(",+,60S"), t(q + 30), F.lit("M,"), t(m), F.lit(",0;chrB,"), t(900 + q), F.lit(",-,"), t(80 - q), F.lit("M70S,"), t(60 - m), F.lit(",1;"))
    rows = x.select(F.col("aln_id").alias("read_id"), F.concat(F.lit("chr"), t(F.col("gene_id") % 5)).alias("chr"), (1000 + q).alias("pos"), F.lit("100M55S").alias("cigar"), sa.alias("sa"))
    return L.linked_alignments(rows).select("read_id", F.col("rank").cast("long").alias("rank"), "left_chr", "left_pos", "right_chr", "right_pos", F.col("right_mapq").cast("long").alias("right_mapq"))


# ---------------------------------------------------------------- conversions


@query(f"""with t as ({_KIND_SQL}) select assignment_type, case when assignment_type like 'unique%' then 'known' when assignment_type = 'ambiguous' then 'known_ambiguous' when assignment_type like 'inconsistent%' then 'novel' else 'none' end as read_type, count(*) as n from t group by assignment_type""")
def p23_read_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(Fixtures(spark, sf_dir)).groupBy("assignment_type").agg(F.max(L.read_type(F.col("assignment_type"))).alias("read_type"), F.count("*").alias("n"))


@query("""select tx_id, ';%;' || string_agg(chr || '_' || s || '_' || e || '_' || strand, ';%;' order by s) as introns from fx_introns group by tx_id""")
def p23_intron_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns as coordinates from a text of exons."""
    t = Fixtures(spark, sf_dir).transcripts().where(F.size("introns") > 0)
    return t.select("tx_id", L.intron_coordinates(I.blocks_to_text(F.col("exons")), F.col("chr"), F.col("strand")).alias("introns"))


@query("""with c as (select gene_id, cell_type, count(case when q % 2 = 0 then 1 end) as a, count(case when q % 2 = 1 then 1 end) as b from fx_aln group by gene_id, cell_type)
select gene_id, cast(sum(a) as bigint) as n_even, cast(sum(b) as bigint) as n_odd, trim(',' from string_agg(case when a > 0 then rtrim(repeat(cell_type || ',', a), ',') else '' end, ',' order by cell_type)) as groups_even, trim(',' from string_agg(case when b > 0 then rtrim(repeat(cell_type || ',', b), ',') else '' end, ',' order by cell_type)) as groups_odd from c group by gene_id""".replace("string_agg(case when a > 0 then rtrim(repeat(cell_type || ',', a), ',') else '' end, ',' order by cell_type)", "coalesce(string_agg(rtrim(repeat(cell_type || ',', a), ','), ',' order by cell_type) filter (a > 0), '')").replace("string_agg(case when b > 0 then rtrim(repeat(cell_type || ',', b), ',') else '' end, ',' order by cell_type)", "coalesce(string_agg(rtrim(repeat(cell_type || ',', b), ','), ',' order by cell_type) filter (b > 0), '')"))
def p24_group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per group as lists that hold a group as often as it was counted."""
    c = Fixtures(spark, sf_dir).alignments().groupBy("gene_id", "cell_type").agg(F.count_if(F.col("q") % 2 == 0).alias("even"), F.count_if(F.col("q") % 2 == 1).alias("odd"))
    return L.group_lists(c, "gene_id", "cell_type", ["even", "odd"])


@query("""with f as (select n_name as part, n_nationkey as y from nation where n_nationkey < 20), s as (select r_name as part, r_regionkey as x from region where r_regionkey < 4),
m as (select 's_002um_' || x || '_' || y as two, 's_008um_' || cast(floor(x / 2) as bigint) || '_' || cast(floor(y / 4) as bigint) as eight, 's_016um_0_' || cast(floor(y / 8) as bigint) as sixteen from f cross join s where y % 7 <> 0),
r as (select c_custkey, case when c_custkey % 10 = 0 then n_name else n_name || '|' || r_name end as barcode, n_name, r_name, c_custkey % 10 = 0 as odd from customer join nation on c_nationkey = n_nationkey join region on r_regionkey = c_custkey % 5),
k as (select c_custkey, case when not odd and f.part is not null and s.part is not null then 's_002um_' || s.x || '_' || f.y end as two from r left join f on f.part = n_name left join s on s.part = r_name)
select c_custkey, coalesce(k.two, '*') as spot_2um, coalesce(m.eight, '*') as spot_8um, coalesce(m.sixteen, '*') as spot_16um from k left join m on k.two = m.two""")
def p25_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-part barcodes to spots of three sizes; malformed and unknown ones get a star."""
    x = Fixtures(spark, sf_dir)
    text = lambda c: c.cast("string")
    first, second = x.table("nation").where("n_nationkey < 20").select(F.col("n_name").alias("part"), F.col("n_nationkey").alias("y")), x.table("region").where("r_regionkey < 4").select(F.col("r_name").alias("part"), F.col("r_regionkey").alias("x"))
    grid = first.select("y").crossJoin(second.select("x")).where("y % 7 != 0")  # the spots of a chip
    spots = grid.select(F.concat_ws("_", F.lit("s_002um"), text(F.col("x")), text(F.col("y"))).alias("spot_2um"), F.concat_ws("_", F.lit("s_008um"), text(F.floor(F.col("x") / 2)), text(F.floor(F.col("y") / 4))).alias("spot_8um"), F.concat_ws("_", F.lit("s_016um_0"), text(F.floor(F.col("y") / 8))).alias("spot_16um"))
    people = x.table("customer").join(x.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").withColumn("r_regionkey", F.col("c_custkey") % 5).join(x.table("region").select("r_regionkey", "r_name"), "r_regionkey")
    reads = people.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.col("n_name")).otherwise(F.concat_ws("|", "n_name", "r_name")).alias("barcode"))
    return L.spots_of_parts(reads, "barcode", first, second, spots).select("c_custkey", "spot_2um", "spot_8um", "spot_16um")


@query("""with taken as (select distinct cast(c_custkey as bigint) as id from customer where c_custkey % 3 = 1 or c_custkey between 20 and 40), f as (select p_partkey, row_number() over (order by p_partkey) as k from part),
free as (select n, row_number() over (order by n) as k from (select unnest(range(1, (select count(*) from f) + (select max(id) from taken) + 2)) as n) where n not in (select id from taken))
select p_partkey, n as id from f join free using (k)""")
def p26_new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least free numbers, in order, past those that are taken."""
    x = Fixtures(spark, sf_dir)
    taken = x.table("customer").where("c_custkey % 3 = 1 or c_custkey between 20 and 40").select(F.col("c_custkey").alias("id"))
    return L.new_ids(x.table("part").select("p_partkey"), taken, ["p_partkey"])


@query("""with f as (select distinct chr, s, e, strand from fx_exons), k as (select distinct chr, s, e, strand, 'known.' || s as feature_id from fx_exons where s % 4 = 1)
select f.chr, f.s, f.e, f.strand, coalesce(k.feature_id, f.chr || '.' || row_number() over (partition by f.chr, k.feature_id is null order by f.s, f.e, f.strand)) as feature_id from f left join k on f.chr = k.chr and f.s = k.s and f.e = k.e and f.strand = k.strand""")
def p26_feature_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known ids of equal features, new ones for the rest."""
    e = Fixtures(spark, sf_dir).exons().select("chr", "s", "e", "strand")
    return L.feature_ids(e, e.where("s % 4 = 1").withColumn("feature_id", F.concat(F.lit("known."), F.col("s").cast("string"))))


# ---------------------------------------------------------------- molecules to reads

_READS_SQL = f"""rd as (select t.aln_id, t.read_id, cast(t.gene_id as varchar) as gene_id, t.assignment_type, case when t.mapq < 6 then 'ambiguous' else t.assignment_type end as gene_assignment_type, t.src_tx, a.barcode, a.umi, a.q, t.n_blocks as n_exons, t.e - t.s as length, t.cell_type from ({_KIND_SQL}) t join fx_aln a using (aln_id)),
el as (select *, case when assignment_type like 'inconsistent%' then 'None' else cast(src_tx as varchar) end as transcript_id from rd where gene_assignment_type not in ('noninformative', 'intergenic', 'suspended', 'ambiguous', 'inconsistent_ambiguous') and not (assignment_type like 'inconsistent%' and q % 2 = 0))"""


def _reads(x: Fixtures) -> DataFrame:
    rows = _typed(x)
    several = F.col("assignment_type").startswith("inconsistent") & (F.col("q") % 2 == 0)
    ids = F.when(several, F.array("src_tx", -F.col("src_tx"))).otherwise(F.array("src_tx"))
    return rows.select("aln_id", "read_id", F.col("gene_id").cast("string").alias("gene_id"), "assignment_type", F.when(F.col("mapq") < 6, "ambiguous").otherwise(F.col("assignment_type")).alias("gene_assignment_type"), ids.alias("tx_ids"), "barcode", "umi", F.col("n_blocks").alias("n_exons"), (F.col("e") - F.col("s")).alias("length"), "cell_type")


@query(f"with {_READS_SQL} select aln_id from el")
def u1_eligible_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.eligible(_reads(Fixtures(spark, sf_dir))).select("aln_id")


_MOLECULES_SQL = f"""{_READS_SQL}, n as (select *, row_number() over (partition by gene_id, barcode, umi order by case when assignment_type in ('unique', 'unique_minor_difference') then 0 else 1 end, n_exons desc, length desc, read_id, cast(src_tx as varchar)) as nth from el),
s as (select *, row_number() over (partition by read_id order by gene_id, barcode, umi) as k, bool_or(assignment_type in ('unique', 'unique_minor_difference')) over (partition by read_id) as u from n where nth = 1),
sel as (select * from s where assignment_type in ('unique', 'unique_minor_difference') or (not u and k = 1))"""


def _annotated(x: Fixtures) -> DataFrame:
    return D.with_annotation(_reads(x), D.transcript_sites(x.transcripts()))


@query(f"with {_MOLECULES_SQL} select read_id, gene_id, barcode, umi as molecule, n_exons, transcript_id, case when transcript_id = 'None' then -1 else (select case when x.strand = '-' then min(x.s) - 1 else max(x.e) + 1 end from fx_exons x where x.tx_id = sel.src_tx group by x.strand) end as polya_site from sel")
def u5_reads_of_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read per molecule, conflicts cleared, each read once across genes; UMIs count as they are."""
    found = D.deduplicate(_annotated(Fixtures(spark, sf_dir)), distance=0)
    return found.select("read_id", "gene_id", "barcode", "molecule", "n_exons", "transcript_id", "polya_site")


_SPOTS_SQL = _MOLECULES_SQL.replace("rd as (", "lv as (select unnest(['cell', 'seg']) as level), rd0 as (").replace("\nel as (select", "\nrd as (select rd0.* exclude (barcode, gene_id, read_id), level, case level when 'cell' then case when cast(substr(barcode, 3) as bigint) % 4 = 0 then barcode else 'S' || cast(substr(barcode, 3) as bigint) % 50 end else case when cast(substr(barcode, 3) as bigint) % 4 = 0 then barcode else cell_type end end as barcode, level || '~' || gene_id as gene_id, level || '~' || read_id as read_id from rd0 cross join lv),\nel as (select")


@query(f"with {_SPOTS_SQL} select level, count(*) as n, count(distinct barcode) as spots, count(distinct gene_id) as genes, cast(sum(n_exons) as bigint) as exons from sel group by level")
def u7_spot_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplication once per level of spots, in one plan."""
    x = Fixtures(spark, sf_dir)
    key = F.substring("barcode", 3, 20).cast("long")
    spots = x.alignments().select("barcode", "cell_type").distinct().where(key % 4 != 0).select("barcode", F.concat(F.lit("S"), (key % 50).cast("string")).alias("cell"), F.col("cell_type").alias("seg"))
    found = D.by_spots(_annotated(x), spots, ["cell", "seg"], distance=0)
    return found.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("barcode").alias("spots"), F.count_distinct("gene_id").alias("genes"), F.sum("n_exons").cast("long").alias("exons"))


@query(f"""with {_MOLECULES_SQL}, ok as (select *, gene_assignment_type in ('ambiguous', 'inconsistent_ambiguous') as amb, gene_assignment_type not in ('noninformative', 'intergenic', 'suspended') as usable, assignment_type like 'inconsistent%' and q % 2 = 0 as multi from rd),
c as (select count(case when usable and not amb then 1 end) as a, count(case when usable and (amb or not multi) then 1 end) as b, count(case when usable and (amb or not multi) and n_exons > 1 then 1 end) as s, count(case when usable and not amb and not multi then 1 end) as u, count(case when usable and not amb and not multi and n_exons > 1 then 1 end) as us from ok),
z as (select count(distinct (gene_id, barcode)) as p, count(*) as t, count(case when n_exons > 1 then 1 end) as sp from sel)
select v.name, v.n from c, z, lateral (values ('Total assignments processed', a), ('Assigned to any gene', b), ('Spliced', s), ('Uniquely assigned', u), ('Uniquely assigned and spliced', us), ('Assigned to any gene and barcoded', u), ('Spliced and barcoded', us), ('Uniquely assigned and barcoded', u), ('Uniquely assigned and spliced and barcoded', us), ('Unique gene-barcodes pairs', p), ('Total reads saved', t), ('Spliced reads saved', sp)) as v(name, n)""")
def u8_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went into the de-duplication, and what it saved."""
    rows = _annotated(Fixtures(spark, sf_dir))
    return D.counters(rows, D.deduplicate(rows, distance=0))


# ---------------------------------------------------------------- fusions


@query("select aln_id from fx_aln where q + 20 >= 50 and mapq >= 10 and not is_secondary")
def f8_fusion_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Fixtures(spark, sf_dir).alignments()
    cigar = F.concat(F.lit("9S"), F.col("q").cast("string"), F.lit("M5I3N20=4S"))
    return X.fusion_reads(x.withColumn("cigar", cigar).withColumn("is_supplementary", F.lit(False))).select("aln_id")


@query("""select biotype, count(*) as n, bool_and(biotype is null or biotype in ('protein_coding', 'IG_C_gene', 'IG_D_gene', 'IG_J_gene', 'IG_V_gene', 'TR_C_gene', 'TR_D_gene', 'TR_J_gene', 'TR_V_gene')) as allowed
from (select case c_mktsegment when 'BUILDING' then 'protein_coding' when 'MACHINERY' then 'lncRNA' when 'HOUSEHOLD' then 'IG_V_gene' when 'FURNITURE' then 'TR_J_gene' end as biotype from customer) group by biotype""")
def f10_biotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"BUILDING": "protein_coding", "MACHINERY": "lncRNA", "HOUSEHOLD": "IG_V_gene", "FURNITURE": "TR_J_gene"}
    kind = F.create_map(*[F.lit(v) for k in names.items() for v in k])[F.col("c_mktsegment")]
    rows = Fixtures(spark, sf_dir).table("customer").select(kind.alias("biotype"))
    return rows.groupBy("biotype").agg(F.count("*").alias("n"), F.min(X.is_allowed_biotype(F.col("biotype"))).alias("allowed"))


# Points of fusions: pairs of gene names, with families of artifacts, drivers, unnamed genes and mitochondria among them.
_NAME = "case when {0} % 31 = 0 then 'ABL1' when {0} % 11 = 0 then 'KRT' || {0} when {0} % 13 = 0 then 'ENSG' || {0} when {0} % 17 = 0 then 'MT-' || {0} else 'G' || {0} end"
_POINTS_SQL = f"""pt as (select read_id, least({_NAME.format('(gene_id % 40)')}, {_NAME.format('(q % 40)')}) as gene_a, greatest({_NAME.format('(gene_id % 40)')}, {_NAME.format('(q % 40)')}) as gene_b, gene_id * 37 % 5000 as pos_a, q * 90 as pos_b from fx_aln where mapq >= 12),
wa as (select distinct gene_a, gene_b, pos_a as a0, pos_b as b0 from (select a.gene_a, a.gene_b, a.pos_a, b.pos_b from pt a join pt b using (gene_a, gene_b) where a.pos_a = b.pos_a and a.pos_b = b.pos_b)),
ct as (select gene_a, gene_b, pos_a, pos_b, count(*) as n from pt group by gene_a, gene_b, pos_a, pos_b),
ws as (select w.gene_a, w.gene_b, a0, b0, sum(n) as reads, sum(pos_a * n) as sa, sum(pos_b * n) as sb from (select gene_a, gene_b, pos_a as a0, pos_b as b0 from ct) w join ct c on c.gene_a = w.gene_a and c.gene_b = w.gene_b and c.pos_a >= a0 and c.pos_a < a0 + 2000 and c.pos_b >= b0 and c.pos_b < b0 + 2000 group by w.gene_a, w.gene_b, a0, b0),
wb as (select *, row_number() over (partition by gene_a, gene_b order by reads desc, a0, b0) as k from ws), su as (select gene_a, gene_b, count(distinct read_id) as support from pt group by gene_a, gene_b),
gt as (select su.gene_a, su.gene_b, support, cast(reads as bigint) as window_reads, cast(floor(sa / reads) as bigint) as consensus_a, cast(floor(sb / reads) as bigint) as consensus_b from su join wb on su.gene_a = wb.gene_a and su.gene_b = wb.gene_b and k = 1)"""


def _points(x: Fixtures) -> DataFrame:
    def name(c):
        t = c.cast("string")
        return F.when(c % 31 == 0, "ABL1").when(c % 11 == 0, F.concat(F.lit("KRT"), t)).when(c % 13 == 0, F.concat(F.lit("ENSG"), t)).when(c % 17 == 0, F.concat(F.lit("MT-"), t)).otherwise(F.concat(F.lit("G"), t))

    a, b = name(F.col("gene_id") % 40), name(F.col("q") % 40)
    return x.alignments().where("mapq >= 12").select("read_id", F.least(a, b).alias("gene_a"), F.greatest(a, b).alias("gene_b"), (F.col("gene_id") * 37 % 5000).alias("pos_a"), (F.col("q") * 90).alias("pos_b"))


@query(f"with {_POINTS_SQL} select * from gt where support >= 3")
def x8_gated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with enough reads and a breakpoint window."""
    return X.gate(_points(Fixtures(spark, sf_dir)), ["gene_a", "gene_b"], least=3)


_JUDGED_SQL = f"""{_POINTS_SQL},
nm as (select *, case when gene_a like 'ENSG%' then 'intergenic' else gene_a end as symbol_a, case when gene_b like 'ENSG%' then 'intergenic' else gene_b end as symbol_b, case when substr(gene_a, 1, 1) = 'G' and substr(gene_a, 2) in ('3', '7') then 'lncRNA' when gene_a like 'G%' then 'protein_coding' end as biotype_a, case when substr(gene_b, 1, 1) = 'G' and substr(gene_b, 2) in ('3', '7') then 'lncRNA' when gene_b like 'G%' then 'protein_coding' end as biotype_b from gt),
fq as (select gene, count(*) as n from (select gene_a as gene from gt union all select gene_b from gt) group by gene),
od as (select gene from fq where n > 30),
j0 as (select nm.*, coalesce(biotype_a, 'protein_coding') = 'lncRNA' or coalesce(biotype_b, 'protein_coding') = 'lncRNA' as nc, symbol_a like 'KRT%' and symbol_b like 'KRT%' as pr, gene_a in (select gene from od) or gene_b in (select gene from od) as fr,
  symbol_a = 'intergenic' or symbol_b = 'intergenic' as un, symbol_a like 'MT-%' or symbol_b like 'MT-%' as mt,
  greatest(0, least(1, least(support, 10) / 10.0 + case when symbol_a like 'KRT%' or symbol_b like 'KRT%' then -0.3 else 0 end + case when symbol_a = 'ABL1' or symbol_b = 'ABL1' then 0.2 else 0 end)) as conf from nm),
j1 as (select *, case when support < 2 then 'canonical' when un then 'intergenic' when symbol_a = symbol_b then 'intragenic' else 'canonical' end as class,
  case when nc then 'non-coding partner' when pr then 'multicopy artifact pair' when fr then 'frequent gene' when support < 2 then 'low support' when un then 'missing gene name' when symbol_a = symbol_b then 'one locus' when mt then 'mitochondrial' else '' end as reasons from j0)"""


def _judged(x: Fixtures) -> DataFrame:
    found = X.gate(_points(x), ["gene_a", "gene_b"]).withColumn("chr_a", F.lit("chr1")).withColumn("chr_b", F.lit("chr2"))
    genes = found.select(F.explode(F.array("gene_a", "gene_b")).alias("gene")).distinct()
    kind = F.when(F.col("gene").isin("G3", "G7"), "lncRNA").when(F.col("gene").startswith("G"), "protein_coding")
    return X.cascade(X.with_genes(found, genes.select("gene", F.col("gene").alias("symbol"), kind.alias("biotype"))), most=30, most_special=30)


@query(f"with {_JUDGED_SQL} select gene_a, gene_b, class, reasons, reasons = '' as valid, round(cast(conf as double), 3) as confidence from j1")
def x9_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, reasons and confidence of every candidate."""
    return _judged(Fixtures(spark, sf_dir)).select("gene_a", "gene_b", "class", F.array_join("reasons", ";").alias("reasons"), "valid", "confidence")


@query(f"""with {_JUDGED_SQL} select symbol_a as "LeftGene", coalesce(biotype_a, 'unknown') as "LeftBiotype", 'chr1' as "LeftChromosome", consensus_a as "LeftBreakpoint", symbol_b as "RightGene", coalesce(biotype_b, 'unknown') as "RightBiotype", 'chr2' as "RightChromosome", consensus_b as "RightBreakpoint",
support as "SupportingReads", symbol_a || '-' || symbol_b as "FusionName", class as "Class", reasons = '' as "Valid", printf('%.3f', round(cast(conf as double), 3)) as "Confidence", reasons as "Reasons" from j1 where round(cast(conf as double), 3) >= 0.3 and class = 'canonical' and symbol_a <> symbol_b""")
def k13_fusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fusion report."""
    return X.fusion_table(_judged(Fixtures(spark, sf_dir)))


# ---------------------------------------------------------------- tables of assignments and counts


@query("""with x as (select tx_id, gene_id, strand, min(s) as ts, max(e) as te, sum(e - s + 1) as len, count(*) as n from fx_exons group by tx_id, gene_id, strand),
b as (select aln_id, min(s) as rs, max(e) as re, sum(e - s + 1) as len, count(*) as n from fx_blocks group by aln_id),
p as (select a.aln_id, a.gene_id, t.tx_id, b.rs, b.re, t.ts, t.te from fx_aln a join b using (aln_id) join x t on t.gene_id = a.gene_id),
d as (select p.aln_id, p.tx_id, case when rs < ts then -(select sum(greatest(0, least(y.e + 1, ts) - y.s)) from fx_blocks y where y.aln_id = p.aln_id) else (select sum(greatest(0, least(y.e + 1, rs) - y.s)) from fx_exons y where y.tx_id = p.tx_id) end as l,
  case when re > te then -(select sum(greatest(0, y.e - greatest(y.s - 1, te))) from fx_blocks y where y.aln_id = p.aln_id) else (select sum(greatest(0, y.e - greatest(y.s - 1, re))) from fx_exons y where y.tx_id = p.tx_id) end as r, ts from p),
g as (select aln_id, arg_min(l, (abs(l), ts, tx_id)) as gl, arg_min(r, (abs(r), ts, tx_id)) as gr from d group by aln_id)
select a.aln_id as isoform, cast(b.len as varchar) as length, cast(b.n as varchar) as exons, cast(x.len as varchar) as ref_length, cast(x.n as varchar) as ref_exons, cast(cast(case when x.strand = '-' then d.r else d.l end as bigint) as varchar) as "diff_to_TSS", cast(cast(case when x.strand = '-' then d.l else d.r end as bigint) as varchar) as "diff_to_TTS",
  cast(cast(abs(case when x.strand = '-' then gr else gl end) as bigint) as varchar) as near_tss, cast(cast(abs(case when x.strand = '-' then gl else gr end) as bigint) as varchar) as near_tts
from fx_aln a join b using (aln_id) join x on x.tx_id = a.src_tx join d on d.aln_id = a.aln_id and d.tx_id = a.src_tx join g on g.aln_id = a.aln_id""")
def k4_structural_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and end distances of the structural table, for reads with the transcript that they come from."""
    x = Fixtures(spark, sf_dir)
    rows = x.reads().select(F.col("aln_id").alias("read_id"), "chr", "strand", "blocks", "gene_id", F.col("src_tx").alias("tx_id"), F.lit("full_splice_match").alias("class"), F.array(F.struct(F.lit("fsm").alias("event"))).alias("events"))
    t = sinks.sqanti_table(rows, x.transcripts())
    near = lambda c: F.abs(F.col(c).cast("long")).cast("string")
    return t.select("isoform", "length", "exons", "ref_length", "ref_exons", "diff_to_TSS", "diff_to_TTS", near("diff_to_gene_TSS").alias("near_tss"), near("diff_to_gene_TTS").alias("near_tts"))


@query("""with c as (select gene_id, cell_type, count(case when q % 2 = 0 then 1 end) as i, count(case when q % 2 = 1 then 1 end) as x from fx_aln group by gene_id, cell_type),
k as (select *, dense_rank() over (order by gene_id) as row, dense_rank() over (order by cell_type) as col from c)
select 'include' as kind, cast(row as integer) as row, cast(col as integer) as "column", i as count from k where i <> 0 union all select 'exclude', row, col, x from k where x <> 0""")
def k8_include_exclude_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sparse matrices with common ids."""
    c = Fixtures(spark, sf_dir).alignments().groupBy("gene_id", "cell_type").agg(F.count_if(F.col("q") % 2 == 0).alias("include_counts"), F.count_if(F.col("q") % 2 == 1).alias("exclude_counts"))
    return C.include_exclude_matrices(c, "gene_id", "cell_type")


# ---------------------------------------------------------------- models


@query("""with m as (select tx_id, gene_id, count(*) as n_exons, tx_id % 9 + 1 as reads, (tx_id % 7) * 10 as mapq, 100 * (gene_id % 3 + 1) as component_reads, tx_id % 4 = 0 as known from fx_exons group by tx_id, gene_id)
select tx_id from m where known or (reads >= greatest(3.0, 0.02 * component_reads) and (n_exons > 2 or mapq >= 30))""")
def g13_filtered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that their component's coverage and their mapping quality allow."""
    m = Fixtures(spark, sf_dir).transcripts().select("tx_id", "exons", "introns", F.when(F.col("tx_id") % 4 == 0, "known").otherwise("NIC").alias("kind"), (F.col("tx_id") % 9 + 1).alias("reads"), ((F.col("tx_id") % 7) * 10).alias("mapq"), (100 * (F.col("gene_id") % 3 + 1)).alias("component_reads"))
    return G.filter_models(m).select("tx_id")


_OWNED_SQL = "ow as (select aln_id as read_id, 'm' || src_tx as model, case when q % 3 = 0 then 'm' || (src_tx + 1) when q % 3 = 1 then 'm' || src_tx end as path_model from fx_aln where src_tx % 5 <> 1 or q % 3 <> 1), md as (select distinct 'm' || tx_id as model, case when tx_id % 2 = 0 then 'known' else 'NIC' end as kind, tx_id % 3 <> 0 as from_path from fx_exons)"


@query(f"""with {_OWNED_SQL}, n as (select model, count(*) as n from ow group by model), st as (select md.model, kind <> 'known' or coalesce(n, 0) = 0 as claims from md left join n using (model))
select ow.read_id, case when coalesce(not md.from_path and st.claims and ow.path_model <> ow.model, false) then ow.path_model else ow.model end as model from ow left join md on md.model = ow.model left join st on st.model = ow.path_model""")
def g17_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that go back to the model of their path."""
    x = Fixtures(spark, sf_dir)
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    q, t = F.col("q"), F.col("src_tx")
    owned = x.alignments().where("src_tx % 5 != 1 or q % 3 != 1").select(F.col("aln_id").alias("read_id"), name(t).alias("model"), F.when(q % 3 == 0, name(t + 1)).when(q % 3 == 1, name(t)).alias("path_model"))
    models = x.exons().select("tx_id").distinct().select(name(F.col("tx_id")).alias("model"), F.when(F.col("tx_id") % 2 == 0, "known").otherwise("NIC").alias("kind"), (F.col("tx_id") % 3 != 0).alias("from_path"))
    return G.resolve_ownership(owned, models)


@query("""with st as (select gene_id, chr, s, e, (e + 400 + (s % 90)) as site, s % 5 + 1 as reads from (select distinct gene_id, chr, s, e from fx_introns)), pr as (select distinct gene_id, max(e) over (partition by gene_id) + 5 as pos from fx_exons),
en as (select distinct gene_id, chr, s, e from (select *, row_number() over (partition by tx_id order by s desc) as k from fx_introns) where k = 1),
z as (select st.*, (select arg_min(p.pos, abs(p.pos - st.site)) from pr p where p.gene_id = st.gene_id and abs(p.pos - st.site) <= 50) as near, exists (select 1 from en where en.gene_id = st.gene_id and en.s = st.s and en.e = st.e) as t from st)
select gene_id, chr, s, e, case when t and near is not null then near else site end as site, cast(sum(reads) as bigint) as reads from z group by gene_id, chr, s, e, case when t and near is not null then near else site end""")
def g7_refined_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal sites moved to predicted ones of their gene, on its terminal introns only."""
    x = Fixtures(spark, sf_dir)
    sites = x.introns().select("gene_id", "chr", "s", "e").distinct().withColumn("site", F.col("e") + 400 + F.col("s") % 90).withColumn("reads", F.col("s") % 5 + 1)
    predicted = x.exons().groupBy("gene_id").agg((F.max("e") + 5).alias("pos"))
    ends = x.transcripts().where(F.size("introns") > 0).select("gene_id", "chr", F.element_at("introns", -1).alias("i")).select("gene_id", "chr", "i.s", "i.e")
    return G.refine_ends(sites, predicted, ends)


def _graph(x: Fixtures) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reads, edges and terminal vertices: ends of transcripts by strand as tails, and the outermost ends of reads as bare ones."""
    from ..operators import discovery as GD

    reads = x.reads().join(x.alignments().select("aln_id", "polya_found"), "aln_id").select(F.col("aln_id").alias("read_id"), "chr", "strand", "gene_id", "introns", "span", F.when(F.col("polya_found"), F.col("e")).alias("polya"), F.when(F.col("polya_found"), F.col("s")).alias("polyt"))
    t = x.transcripts().where(F.size("introns") > 0)
    end = lambda side, at, pos: t.select("chr", F.element_at("introns", at).alias("i"), F.lit(side).alias("side"), F.when(F.col("strand") == ("+" if side == "right" else "-"), "polya" if side == "right" else "polyt").otherwise("tss").alias("kind"), F.col(pos).alias("pos"))
    hung = end("right", -1, "span.e").unionByName(end("left", 1, "span.s")).select("chr", "i.s", "i.e", "side", "kind", "pos").distinct()
    return reads, GD.intron_edges(x.reads()), hung


@query("select 0 as far_ends, 0 as half_paths, 0 as lost_reads")
def g9_path_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threaded ends lie near the read's, a tail ends at its nearest confirmed site, paths are full with two ends and a tail and only
    then, and every spliced read is threaded. What a read ought to have is looked up anew, so that ends that are not found count too."""
    x = Fixtures(spark, sf_dir)
    reads, edges, hung = _graph(x)
    t = G.thread_paths(reads, edges, hung)
    plus = F.col("strand") == "+"
    i = F.when(plus, F.element_at("introns", -1)).otherwise(F.element_at("introns", 1))
    sites = hung.where("side = 'right' and kind = 'polya' or side = 'left' and kind = 'polyt'").groupBy("chr", F.col("side").alias("_side"), F.col("s").alias("_is"), F.col("e").alias("_ie")).agg(F.collect_set("pos").alias("_sites"))
    t = t.withColumn("_side", F.when(plus, "right").otherwise("left")).withColumn("_is", i["s"]).withColumn("_ie", i["e"]).join(sites, ["chr", "_side", "_is", "_ie"], "left")
    own, edge = F.when(plus, F.col("right")).otherwise(F.col("left")), F.when(plus, F.col("span.e")).otherwise(F.col("span.s"))
    nearest = F.array_min(F.transform("_sites", lambda p: F.abs(p - edge)))
    due = F.when(plus, F.col("polya")).otherwise(F.col("polyt")).isNotNull() & (nearest <= 50)
    reached = own["kind"].isin("polya", "polyt") & (F.abs(own["pos"] - edge) == nearest)
    far = (F.abs(F.col("right.pos") - F.col("span.e")) > 200) | (F.abs(F.col("left.pos") - F.col("span.s")) > 200)
    whole = F.col("left").isNotNull() & F.col("right").isNotNull() & F.coalesce((F.col("right.kind") == "polya") | (F.col("left.kind") == "polyt"), F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False))
    spliced = reads.where(F.size("introns") > 0).count()
    return t.agg(F.count_if(no(far) | (no(due) & ~no(reached))).cast("int").alias("far_ends"), F.count_if(no(F.col("full")) != whole).cast("int").alias("half_paths"), (F.lit(spliced) - F.count("*")).cast("int").alias("lost_reads"))


@query()
def g9_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of reads with their counts; tested on cases against a plain version."""
    reads, edges, hung = _graph(Fixtures(spark, sf_dir))
    c = G.count_paths(G.thread_paths(reads, edges, hung))
    end = lambda n: F.concat_ws(":", f"{n}.kind", F.col(f"{n}.pos").cast("string"))
    return c.select("chr", "strand", I.blocks_to_text(F.col("introns")).alias("introns"), end("left").alias("left"), end("right").alias("right"), "full", "reads")


@query()
def g10_models_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of full-length paths."""
    x = Fixtures(spark, sf_dir)
    m = G.full_length_models(G.count_paths(G.thread_paths(*_graph(x))), x.transcripts())
    return m.select("model", "kind", "chr", "strand", I.blocks_to_text(F.col("exons")).alias("exons"), "reads", "polya_confirmed")


@query("select 0 as unknown_known, 0 as weak_novel, 0 as odd_exons")
def g10_model_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known models carry a transcript's id, novel ones enough reads, and exons fit introns."""
    x = Fixtures(spark, sf_dir)
    m = G.full_length_models(G.count_paths(G.thread_paths(*_graph(x))), x.transcripts())
    return m.agg(F.count_if((F.col("kind") == "known") & F.col("model").startswith("model_")).cast("int").alias("unknown_known"), F.count_if((F.col("kind") != "known") & (F.col("reads") < 3)).cast("int").alias("weak_novel"), F.count_if(F.size("exons") != F.size("introns") + 1).cast("int").alias("odd_exons"))


def _models(x: Fixtures, short: bool = False) -> DataFrame:
    """Transcripts as models: every fourth known, the others novel; with short, shortened novel copies of the known ones too."""
    t = x.transcripts()
    name = lambda letter: F.concat(F.lit(letter), F.col("tx_id").cast("string")).alias("model")
    rest = [(F.col("tx_id") % 9).alias("reads"), (F.col("tx_id") % 3 == 0).alias("polya_confirmed")]
    rows = t.select(name("m"), F.when(F.col("tx_id") % 4 == 0, "known").otherwise("NIC").alias("kind"), "gene_id", "chr", "strand", "exons", *rest)
    if short:
        rows = rows.unionByName(t.where("tx_id % 4 = 0").select(name("s"), F.lit("NIC").alias("kind"), "gene_id", "chr", "strand", F.slice("exons", F.lit(1), F.size("exons") - 1).alias("exons"), *rest))
    return rows.withColumn("introns", I.junctions(F.col("exons"))).withColumn("span", I.region(F.col("exons")))


@query("select 's' || tx_id as model, 'm' || tx_id as \"into\" from (select distinct tx_id from fx_exons where tx_id % 4 = 0)")
def g13_similar_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novel models that another one contains."""
    return G.similar_models(_models(Fixtures(spark, sf_dir), True))


@query("select 0 as held_elsewhere, 0 as unknown_models")
def g16_reassignment_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads bound to a known isoform stay on it or go nowhere; others go to models only."""
    x = Fixtures(spark, sf_dir)
    models = _models(x).where("kind = 'known' or reads > 4")
    reads = x.reads().join(x.alignments().select("aln_id", "q"), "aln_id").select(F.col("aln_id").alias("read_id"), "chr", "gene_id", "blocks", "introns", "span", F.when(F.col("q") % 2 == 0, "unique").otherwise("ambiguous").alias("assignment_type"), F.concat(F.lit("m"), F.col("src_tx").cast("string")).alias("isoform_id"))
    found = G.reassign(reads, models).join(reads.select("read_id", "assignment_type", "isoform_id"), "read_id").join(models.select("model", F.lit(True).alias("_is")), "model", "left")
    return found.agg(F.count_if((F.col("assignment_type") == "unique") & F.col("model").isNotNull() & (F.col("model") != F.col("isoform_id"))).cast("int").alias("held_elsewhere"), F.count_if(F.col("model").isNotNull() & F.col("_is").isNull()).cast("int").alias("unknown_models"))


@query("""with m as (select 'm' || tx_id as model, gene_id, tx_id, count(*) as n from fx_exons group by tx_id, gene_id), g as (select gene_id, count(*) as k from m group by gene_id)
select model, case when k = 1 then 'A' else 'C' end as "FSM_class" from m join g using (gene_id) where tx_id % 4 <> 0""")
def g21_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novel models against the annotation; how many models their gene has."""
    x = Fixtures(spark, sf_dir)
    return G.compare_with_known(_models(x), x.transcripts()).select("model", "FSM_class")


@query()
def k2_legacy_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older table of assignments of classified reads."""
    from ..operators import classify as K

    x = Fixtures(spark, sf_dir)
    info = x.reads().select("aln_id", "read_id", "chr", "blocks")
    found = K.classify(x.reads(), x.transcripts()).join(info, "aln_id")
    return sinks.legacy_assignments(found)
