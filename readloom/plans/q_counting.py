"""Queries: counting, groups, matrices, multimappers, filters on reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counting as C
from ..operators import multimap as M
from ..operators import regions as R
from .fixtures import Fixtures
from .registry import query

# Assignment types of the fixture: by the number of genes that a read id hits, and by the number of blocks.
_KIND_SQL = """select a.aln_id, a.read_id, a.src_tx, a.gene_id, a.tag_group, a.file_group, a.cell_type, a.is_secondary, a.mapq, a.polya_found, r.n_blocks, r.chr, r.s, r.e, count(*) over (partition by a.read_id) as n_features,
  case when n_blocks = 1 then 'noninformative' when ln = 7 and n_blocks = 2 then 'inconsistent_non_intronic' when ln = 7 then 'inconsistent' when count(*) over (partition by a.read_id) > 1 then 'ambiguous' when n_blocks = 2 then 'unique_minor_difference' else 'unique' end as assignment_type
  from fx_aln a join fx_reads r using (aln_id)"""


def _typed(x: Fixtures) -> DataFrame:
    from pyspark.sql import Window as W

    rows = x.alignments().join(x.reads().select("aln_id", "n_blocks", "chr", "s", "e", "introns", "blocks"), "aln_id").withColumn("n_features", F.count("*").over(W.partitionBy("read_id")))
    kind = F.when(F.col("n_blocks") == 1, "noninformative").when((F.col("ln") == 7) & (F.col("n_blocks") == 2), "inconsistent_non_intronic").when(F.col("ln") == 7, "inconsistent").when(F.col("n_features") > 1, "ambiguous").when(F.col("n_blocks") == 2, "unique_minor_difference").otherwise("unique")
    return rows.withColumn("assignment_type", kind)


@query("""
with o as (select r.aln_id, g.gene_id, r.n_blocks from fx_reads r join fx_genes g on r.chr = g.chr and r.s <= g.e and g.s <= r.e),
u as (select aln_id, max(gene_id) as gene_id, max(n_blocks) as n_blocks from o group by aln_id having count(*) = 1),
c as (select u.gene_id, a.tag_group as group_id, sum(1.0) as n, bool_or(n_blocks > 1) as ok from u join fx_aln a using (aln_id) where not is_secondary group by u.gene_id, a.tag_group),
z as (select gene_id, group_id, case when bool_or(ok) over (partition by gene_id) then n else 0 end as n from c)
select gene_id, group_id, cast(n as double) as count, round(n * 1e6 / sum(n) over (partition by group_id), 4) as tpm from z""")
def gene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: reads to genes by an interval join, unique reads counted per gene and group, with TPM."""
    x = Fixtures(spark, sf_dir)
    reads = x.reads().select("aln_id", "chr", "s", "e", "n_blocks")
    pairs = R.interval_join(reads, x.genes().select("gene_id", "chr", F.col("s").alias("rs"), F.col("e").alias("re")))
    unique = pairs.groupBy("aln_id").agg(F.max("gene_id").alias("gene_id"), F.max("n_blocks").alias("n_blocks"), F.count("*").alias("n")).where("n = 1")
    rows = unique.join(R.filter_alignments(x.alignments().withColumn("chr", F.lit(""))).select("aln_id", F.col("tag_group").alias("group_id")), "aln_id")
    counts = C.count_features(rows, "gene_id", F.lit(1.0), ["group_id"], F.col("n_blocks") > 1)
    return C.tpm(counts, ["group_id"]).select("gene_id", "group_id", "count", F.round("tpm", 4).alias("tpm"))


def _strategy_sql(ambiguous: bool, minor: bool, inconsistent: bool, full: bool) -> str:
    unique = "case when n_blocks >= 3 then 1.0 else 0.0 end" if full else "1.0"
    return f"""
with t as ({_KIND_SQL}), w as (select src_tx, case when assignment_type in ('unique', 'unique_minor_difference') then {unique}
  when assignment_type = 'ambiguous' then case when n_features = 1 then 1.0 else {'1.0 / n_features' if ambiguous else '0.0'} end
  when assignment_type like 'inconsistent%' and n_features > 1 then {'1.0 / n_features' if ambiguous and inconsistent else '0.0'}
  when assignment_type = 'inconsistent' then {'1.0' if inconsistent else '0.0'} when assignment_type = 'inconsistent_non_intronic' then {'1.0' if inconsistent or minor else '0.0'} else 0.0 end as w,
  assignment_type in ('unique', 'unique_minor_difference') and n_blocks > 1 as ok from t),
c as (select src_tx, sum(w) as n, bool_or(ok) as ok from w group by src_tx)
select e.tx_id as src_tx, round(cast(coalesce(case when ok then n else 0 end, 0) as double), 6) as count from (select distinct tx_id from fx_exons) e left join c on e.tx_id = c.src_tx"""


def _strategy(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Fixtures(spark, sf_dir)
        rows = _typed(x)
        confirm = F.col("assignment_type").isin("unique", "unique_minor_difference") & (F.col("n_blocks") > 1)
        counts = C.count_features(rows, "src_tx", C.weights(name, F.col("assignment_type"), F.col("n_features"), F.col("n_blocks") >= 3), None, confirm)
        return C.complete(counts, x.exons().select(F.col("tx_id").alias("src_tx")), "src_tx").select("src_tx", F.round("count", 6).alias("count"))

    run.__name__ = f"a1_counts_{name}"
    run.__doc__ = f"Transcript counts with strategy {name}, confirmed features only, all annotated features listed."
    return query(_strategy_sql(*C.STRATEGIES[name]))(run)


for _name in C.STRATEGIES:
    _strategy(_name)


@query(f"""
with t as ({_KIND_SQL}), g as (
  select src_tx, 'tag' as strategy, tag_group as group_id from t where assignment_type like 'unique%'
  union all select src_tx, 'file', cast(file_group as varchar) from t where assignment_type like 'unique%'
  union all select src_tx, 'cell', cell_type from t where assignment_type like 'unique%')
select src_tx, strategy, group_id, cast(count(*) as double) as count from g group by src_tx, strategy, group_id""")
def a11_grouping_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for all grouping strategies."""
    rows = C.by_strategies(_typed(Fixtures(spark, sf_dir)).where(F.col("assignment_type").startswith("unique")), {"tag": F.col("tag_group"), "file": F.col("file_group"), "cell": F.col("cell_type")})
    return C.count_features(rows, "src_tx", F.lit(1.0), ["strategy", "group_id"])


@query(f"""with t as ({_KIND_SQL}), u as (select cell_type, count(*) as usable from t group by cell_type), c as (select gene_id, cell_type, count(*) as n from t where assignment_type like 'unique%' group by gene_id, cell_type)
select gene_id, cell_type, cast(n as double) as count, round(n * 1e6 / usable, 4) as tpm from c join u using (cell_type)""")
def a5_tpm_usable_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TPM over usable reads of each group."""
    rows = _typed(Fixtures(spark, sf_dir))
    counts = C.count_features(rows.where(F.col("assignment_type").startswith("unique")), "gene_id", F.lit(1.0), ["cell_type"])
    return C.tpm(counts, ["cell_type"], C.usable_reads(rows, ["cell_type"])).select("gene_id", "cell_type", "count", F.round("tpm", 4).alias("tpm"))


@query(f"with t as ({_KIND_SQL}) select assignment_type, count(*) as n from t group by assignment_type")
def a12_type_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.type_stats(_typed(Fixtures(spark, sf_dir)), "assignment_type")


@query("""
with f as (select distinct gene_id, chr, strand, s as fs, e as fe from fx_introns), p as (
  select r.aln_id, f.*, a.cell_type, exists (select 1 from fx_read_introns i where i.aln_id = r.aln_id and abs(i.s - f.fs) <= 6 and abs(i.e - f.fe) <= 6) as inc, f.fs >= r.s and f.fe <= r.e as inside
  from fx_reads r join f on r.gene_id = f.gene_id join fx_aln a on a.aln_id = r.aln_id)
select chr, fs, fe, strand, gene_id, cell_type, count(case when inc then 1 end) as include_counts, count(case when not inc and inside then 1 end) as exclude_counts from p where inc or inside group by chr, fs, fe, strand, gene_id, cell_type""")
def a7_junction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion and exclusion of annotated introns by cell type."""
    x = Fixtures(spark, sf_dir)
    reads = x.reads().select("aln_id", "gene_id", "s", "e", "introns").join(x.alignments().select("aln_id", "cell_type"), "aln_id")
    features = x.introns().select("gene_id", "chr", "strand", F.col("s").alias("fs"), F.col("e").alias("fe")).distinct()
    same = F.exists("introns", lambda i: (F.abs(i["s"] - F.col("fs")) <= 6) & (F.abs(i["e"] - F.col("fe")) <= 6))
    states = reads.join(features, "gene_id").withColumn("state", F.when(same, 1).when((F.col("fs") >= F.col("s")) & (F.col("fe") <= F.col("e")), -1)).where("state is not null")
    return C.include_exclude(states, ["chr", "fs", "fe", "strand", "gene_id", "cell_type"])


@query("""
with f as (select distinct gene_id, s as fs, e as fe from fx_introns),
p as (select f.gene_id, f.fs, f.fe, r.aln_id from f join fx_reads r on r.gene_id = f.gene_id and r.s <= f.fs and f.fe <= r.e where exists (select 1 from fx_blocks b where b.aln_id = r.aln_id and b.s <= f.fs and f.fe <= b.e))
select gene_id, fs, fe, count(*) as retained from p group by gene_id, fs, fe""")
def a8_intron_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with a block over a whole annotated intron."""
    x = Fixtures(spark, sf_dir)
    f = x.introns().select("gene_id", F.col("s").alias("fs"), F.col("e").alias("fe")).distinct()
    p = x.reads().select("gene_id", "blocks").join(f, "gene_id").where(F.exists("blocks", lambda b: (b["s"] <= F.col("fs")) & (F.col("fe") <= b["e"])))
    return p.groupBy("gene_id", "fs", "fe").agg(F.count("*").alias("retained"))


@query("""
with g as (select gene_id, s, e, min(s) over (partition by gene_id, k) as rs, max(e) over (partition by gene_id, k) as re from (
  select distinct gene_id, s, e, cast(floor((s % 1500) / 300) as bigint) as k from fx_exons)),
p as (select r.aln_id, g.gene_id, g.rs, g.re, g.s as exon_s, g.e as exon_e, case when exists (select 1 from fx_blocks b where b.aln_id = r.aln_id and abs(b.s - g.s) <= 2 and abs(b.e - g.e) <= 2) then 1
  when exists (select 1 from fx_blocks b where b.aln_id = r.aln_id and b.s <= g.e and g.s <= b.e) and not (r.s < g.s and g.e < r.e) then 0 when r.s < g.s and g.e < r.e then -1 else 0 end as state from fx_reads r join g on r.gene_id = g.gene_id),
k as (select *, min(abs(state)) over (partition by gene_id, rs, re, aln_id) as lo, max(state) over (partition by gene_id, rs, re, aln_id) as hi from p)
select gene_id, rs, re, exon_s, exon_e, count(*) as count from k where lo > 0 and state = 1 group by gene_id, rs, re, exon_s, exon_e
union all select gene_id, rs, re, null, null, count(distinct aln_id) from k where lo > 0 and hi = -1 group by gene_id, rs, re""")
def a9_joint_exon_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of an exon region, each with its reads, and the region's exclusion."""
    x = Fixtures(spark, sf_dir)
    exons = R.islands(x.exons().select("gene_id", "s", "e").distinct(), ["gene_id"])
    bounds = exons.groupBy("gene_id", "island").agg(F.min("s").alias("rs"), F.max("e").alias("re"))
    g = exons.join(bounds, ["gene_id", "island"]).select("gene_id", "rs", "re", F.col("s").alias("exon_s"), F.col("e").alias("exon_e"))
    p = x.reads().select("aln_id", "gene_id", "s", "e", "blocks").join(g, "gene_id")
    same = F.exists("blocks", lambda b: (F.abs(b["s"] - F.col("exon_s")) <= 2) & (F.abs(b["e"] - F.col("exon_e")) <= 2))
    inside = (F.col("s") < F.col("exon_s")) & (F.col("exon_e") < F.col("e"))
    p = p.withColumn("state", F.when(same, 1).when(inside, -1).otherwise(0))
    return C.joint_exon_regions(p, ["gene_id", "rs", "re"], "aln_id").select("gene_id", "rs", "re", "exon_s", "exon_e", "count")


@query("""
with g as (select distinct gene_id, s as rs, e as re from fx_exons), p as (select g.*, r.s, r.e,
  exists (select 1 from fx_blocks b where b.aln_id = r.aln_id and abs(b.s - g.rs) <= 2 and abs(b.e - g.re) <= 2) as f, exists (select 1 from fx_blocks b where b.aln_id = r.aln_id and abs(b.s - g.rs) <= 2 and b.e >= g.rs) as l,
  exists (select 1 from fx_blocks b where b.aln_id = r.aln_id and abs(b.e - g.re) <= 2 and b.s <= g.re) as t, exists (select 1 from fx_blocks b where b.aln_id = r.aln_id and b.s <= g.re and b.e >= g.rs) as c from fx_reads r join g on r.gene_id = g.gene_id),
k as (select *, case when f then 'full' when l and not t then 'left' when t and not l then 'right' when s <= rs - 50 and e >= re + 50 and not c then 'exclusion' when c then 'ambiguous' end as kind from p)
select gene_id, rs, re, count(case when kind = 'full' then 1 end) as n_full, count(case when kind = 'left' then 1 end) as n_left, count(case when kind = 'right' then 1 end) as n_right,
       count(case when kind = 'exclusion' then 1 end) as n_exclusion, count(case when kind = 'ambiguous' then 1 end) as n_ambiguous from k where kind is not null group by gene_id, rs, re""")
def a10_splice_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full, left, right, excluded and ambiguous reads of each exon."""
    x = Fixtures(spark, sf_dir)
    g = x.exons().select("gene_id", F.col("s").alias("rs"), F.col("e").alias("re")).distinct()
    return C.splice_site_cascade(x.reads().select("gene_id", "s", "e", "blocks").join(g, "gene_id"), ["gene_id", "rs", "re"], 50, 2)


@query("""
select gene_id, cast(coalesce(sum(n) filter (cell_type = 'BUILDING'), 0) as bigint) as "BUILDING", cast(coalesce(sum(n) filter (cell_type = 'MACHINERY'), 0) as bigint) as "MACHINERY" from (select gene_id, cell_type, count(*) as n from fx_aln group by gene_id, cell_type) group by gene_id""")
def k6_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by groups."""
    counts = Fixtures(spark, sf_dir).alignments().groupBy("gene_id", "cell_type").agg(F.count("*").alias("count"))
    return C.matrix(counts, "gene_id", "cell_type", ["BUILDING", "MACHINERY"])


@query("""
with c as (select gene_id, cell_type, count(*) as n from fx_aln group by gene_id, cell_type)
select cast(dense_rank() over (order by gene_id) as integer) as row, cast(dense_rank() over (order by cell_type) as integer) as column, n as count from c""")
def k7_matrix_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with dense ids from 1."""
    counts = Fixtures(spark, sf_dir).alignments().groupBy("gene_id", "cell_type").agg(F.count("*").alias("count"))
    return C.matrix_market(counts, "gene_id", "cell_type")


_CAND = """select aln_id, read_id, gene_id, src_tx as isoform_id, 'chr' || cast(gene_id % 5 as varchar) as chr, gene_id * 1500 as s, gene_id * 1500 + 1000 as e, gene_id * 1500 as region_s, q as overlap, not is_secondary as is_primary, cast(ln as double) / 10 as penalty,
  case when mapq < 6 then 'noninformative' when q > 40 then 'inconsistent' when q > 35 then 'inconsistent_non_intronic' when q % 2 = 0 then 'unique' when q % 5 = 0 then 'unique_minor_difference' else 'ambiguous' end as assignment_type from fx_aln"""


def _candidates(x: Fixtures) -> DataFrame:
    q = F.col("q")
    kind = F.when(F.col("mapq") < 6, "noninformative").when(q > 40, "inconsistent").when(q > 35, "inconsistent_non_intronic").when(q % 2 == 0, "unique").when(q % 5 == 0, "unique_minor_difference").otherwise("ambiguous")
    g = F.col("gene_id")
    return x.alignments().select("aln_id", "read_id", "gene_id", F.col("src_tx").alias("isoform_id"), F.concat(F.lit("chr"), (g % 5).cast("string")).alias("chr"), (g * 1500).alias("s"), (g * 1500 + 1000).alias("e"), (g * 1500).alias("region_s"), q.alias("overlap"), (~F.col("is_secondary")).alias("is_primary"), (F.col("ln").cast("double") / 10).alias("penalty"), kind.alias("assignment_type"))


def _resolve_sql(cost: str) -> str:
    return f"""
with c as ({_CAND}), p as (select *, case when is_primary and assignment_type like 'unique%' then 1 when assignment_type in ('unique', 'unique_minor_difference', 'ambiguous') then 2
  when is_primary and assignment_type like 'inconsistent%' then 3 when assignment_type like 'inconsistent%' then 4 else 5 end as p from c),
b as (select *, count(*) over (partition by read_id) as n_alignments, min(p) over (partition by read_id) as best, row_number() over (partition by read_id order by p, overlap desc, region_s, aln_id) as first,
  rank() over (partition by read_id order by p, case when p in (3, 4) then {cost} else 0.0 end) as r from p),
k as (select *, p = best and case when best = 5 then first = 1 else r = 1 end as k0 from b),
d as (select *, k0 and row_number() over (partition by read_id, k0, chr, s, e, isoform_id order by aln_id) = 1 as kept from k),
n as (select read_id, count(distinct isoform_id) as ni, count(distinct gene_id) as ng from d where kept group by read_id)
select aln_id, d.read_id, n_alignments, kept, case when not kept then 'suspended' when (ni > 1 or ng > 1) and assignment_type like 'inconsistent%' then 'inconsistent_ambiguous'
  when (ni > 1 or ng > 1) and assignment_type in ('unique', 'unique_minor_difference', 'ambiguous') then 'ambiguous' else assignment_type end as resolved_type from d join n on d.read_id = n.read_id"""


@query(_resolve_sql("0.0"))
def m3_take_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multimapper resolution with the observed behaviour (penalties of inconsistent candidates tie)."""
    return M.resolve(_candidates(Fixtures(spark, sf_dir))).select("aln_id", "read_id", "n_alignments", "kept", "resolved_type")


@query(_resolve_sql("penalty"))
def m4_take_best_by_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with actual penalties."""
    return M.resolve(_candidates(Fixtures(spark, sf_dir)), penalty_mode="actual").select("aln_id", "read_id", "n_alignments", "kept", "resolved_type")


@query("""
select read_id, chr, count(*) as n, count(distinct gene_id) as genes from (select read_id, 'chr' || cast(gene_id % 5 as varchar) as chr, gene_id from fx_aln) group by read_id, chr""")
def m8_scope_by_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences per read and chromosome, the scope that is used without secondary alignments."""
    x = Fixtures(spark, sf_dir).alignments().withColumn("chr", F.concat(F.lit("chr"), (F.col("gene_id") % 5).cast("string")))
    return x.groupBy("read_id", "chr").agg(F.count("*").alias("n"), F.count_distinct("gene_id").alias("genes"))


@query("""
with bad as (select distinct read_id from fx_aln where mapq < 6) select a.aln_id from fx_aln a where not exists (select 1 from bad where bad.read_id = a.read_id)""")
def f6_suspended_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Fixtures(spark, sf_dir).alignments()
    return x.join(x.where("mapq < 6").select("read_id").distinct(), "read_id", "left_anti").select("aln_id")


@query(f"with t as ({_KIND_SQL}) select aln_id from t where assignment_type in ('unique', 'unique_minor_difference', 'ambiguous', 'inconsistent_non_intronic') and polya_found and not (assignment_type like 'inconsistent%' and mapq < 5)")
def f7_terminal_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that terminal counters accept; poorly mapped inconsistent ones go first."""
    rows = _typed(Fixtures(spark, sf_dir)).where(~(F.col("assignment_type").startswith("inconsistent") & (F.col("mapq") < 5)))
    return rows.where(F.col("assignment_type").isin("unique", "unique_minor_difference", "ambiguous", "inconsistent_non_intronic") & F.col("polya_found")).select("aln_id")


@query("""select a.aln_id, coalesce(g.grp, 'NA') as grp from fx_aln a left join (select c_custkey, c_mktsegment as grp from customer where c_acctbal > 0) g on a.barcode = concat('BC', cast(g.c_custkey as varchar))""")
def j7_read_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups from a table, NA where it has none."""
    x = Fixtures(spark, sf_dir)
    table = x.table("customer").where("c_acctbal > 0").select(F.concat(F.lit("BC"), F.col("c_custkey").cast("string")).alias("barcode"), F.col("c_mktsegment").alias("grp"))
    return x.alignments().select("aln_id", "barcode").join(table, "barcode", "left").select("aln_id", F.coalesce("grp", F.lit("NA")).alias("grp"))


