"""Queries: interval algebra, interval joins, sweeps, filters, annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import intervals as I
from ..operators import regions as R
from .fixtures import Fixtures
from .registry import query


def _pairs(x: Fixtures) -> DataFrame:
    """Overlapping (read, other transcript of any gene) spans."""
    a = x.reads().select("aln_id", "chr", "s", "e")
    b = x.genes().select("gene_id", "chr", F.col("s").alias("rs"), F.col("e").alias("re"))
    return R.interval_join(a, b)


@query("""
select r.aln_id, g.gene_id, least(r.e, g.e) - greatest(r.s, g.s) + 1 as overlap_len
from fx_reads r join fx_genes g on r.chr = g.chr and r.s <= g.e and g.s <= r.e""")
def j1_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with the genes that they overlap, by an equi-join on bins."""
    x = Fixtures(spark, sf_dir)
    return _pairs(x).select("aln_id", "gene_id", I.intersection_len(I.iv("s", "e"), I.iv("rs", "re")).alias("overlap_len"))


@query("""
select r.aln_id, g.gene_id from (select aln_id, chr, s as pos from fx_reads) r join fx_genes g on r.chr = g.chr and r.pos between g.s - 1000 and g.e + 1000""")
def j2_point_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Fixtures(spark, sf_dir)
    points = x.reads().select("aln_id", "chr", F.col("s").alias("pos"))
    return R.point_join(points, x.genes().select("gene_id", "chr", F.col("s").alias("rs"), F.col("e").alias("re")), window=1000).select("aln_id", "gene_id")


@query("""
with p as (select a.tx_id as a, b.tx_id as b, a.s as s1, a.e as e1, b.s as s2, b.e as e2 from fx_exons a join fx_exons b on a.gene_id = b.gene_id and a.tx_id < b.tx_id)
select a, b, s1, e1, s2, e2, not (e1 < s2 or s1 > e2) as overlaps, greatest(s1, s2) as os, least(e1, e2) as oe,
       case when e1 < s2 or s1 > e2 then false when e1 < e2 then s1 >= s2 or e1 - s2 + 1 >= 60 else s1 <= s2 or e2 - s1 + 1 >= 60 end as at_least,
       case when e1 < e2 then s1 >= s2 or e1 - s2 + 1 >= 60 else s1 <= s2 or e2 - s1 + 1 >= 60 end as enough,
       greatest(0, least(e1, e2) - greatest(s1, s2) + 1) as common, e1 < s2 as left_of, abs(s1 - s2) <= 12 and abs(e1 - e2) <= 12 as equal,
       s1 <= s2 and s2 <= e1 and e1 <= e2 as covers_end, s2 <= s1 and s1 <= e2 and e2 <= e1 as covers_start, s1 <= s2 and e2 <= e1 as contains,
       e1 >= e2 + 1 and s1 <= s2 - 1 as well_inside, e1 + 15 >= e2 and s1 - 15 <= s2 as approx, least(s1, s2) as ms, greatest(e1, e2) as me, e1 - s1 + 1 as len
from p""")
def i_scalar_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every predicate and function on two intervals, over exon pairs of a gene."""
    x = Fixtures(spark, sf_dir).exons()
    p = x.select("gene_id", F.col("tx_id").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1")).join(x.select("gene_id", F.col("tx_id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2")), "gene_id").where("a < b")
    a, b = I.iv("s1", "e1"), I.iv("s2", "e2")
    return p.select(
        "a", "b", "s1", "e1", "s2", "e2", I.overlaps(a, b).alias("overlaps"), I.overlap(a, b)["s"].alias("os"), I.overlap(a, b)["e"].alias("oe"), I.overlaps_at_least(a, b, 60).alias("at_least"),
        I.overlaps_enough(a, b, 60).alias("enough"), I.intersection_len(a, b).alias("common"), I.left_of(a, b).alias("left_of"), I.equal_ranges(a, b, 12).alias("equal"), I.covers_end(a, b).alias("covers_end"),
        I.covers_start(a, b).alias("covers_start"), I.contains(a, b).alias("contains"), I.contains_well_inside(a, b).alias("well_inside"), I.contains_approx(a, b, 15).alias("approx"),
        I.max_range(a, b)["s"].alias("ms"), I.max_range(a, b)["e"].alias("me"), I.interval_len(a).alias("len"),
    )


@query("""
with r as (select aln_id, src_tx, min(s) as rs, max(e) as re, sum(e - s + 1) as read_len from fx_blocks group by aln_id, src_tx),
t as (select tx_id, gene_id, sum(e - s + 1) as tx_len, min(s) as ts, max(e) as te from fx_exons group by tx_id, gene_id),
c as (select b.aln_id, x.tx_id, sum(greatest(0, least(b.e, x.e) - greatest(b.s, x.s) + 1)) as common from fx_blocks b join fx_exons x on b.gene_id = x.gene_id group by b.aln_id, x.tx_id),
o as (select b.aln_id, t.tx_id, sum(greatest(0, least(b.e, t.te) - greatest(b.s, t.ts) + 1)) as inside,
      sum(greatest(0, least(b.e + 1, t.ts + 150) - b.s)) as before, sum(greatest(0, b.e - greatest(b.s - 1, t.ts + 150))) as behind
      from fx_blocks b join t on b.gene_id = t.gene_id group by b.aln_id, t.tx_id)
select r.aln_id, t.tx_id, cast(read_len as bigint) as read_len, cast(common as bigint) as common, round(common / (read_len + tx_len - common), 6) as jaccard, round(common / read_len, 6) as coverage,
       round(1 - inside / read_len, 6) as outside, cast(before as bigint) as before, cast(behind as bigint) as behind
from r join c using (aln_id) join t on c.tx_id = t.tx_id join o on o.aln_id = r.aln_id and o.tx_id = t.tx_id""")
def i_block_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-list measures of each read against each transcript of its gene."""
    x = Fixtures(spark, sf_dir)
    p = x.reads().select("aln_id", "gene_id", "blocks").join(x.transcripts().select("tx_id", "gene_id", "exons", F.col("span").alias("tx_span")), "gene_id")
    b, t, at = F.col("blocks"), F.col("exons"), F.col("tx_span.s") + 150
    return p.select(
        "aln_id", "tx_id", I.total_length(b).alias("read_len"), I.common_length(b, t).alias("common"), F.round(I.jaccard(b, t), 6).alias("jaccard"), F.round(I.coverage_fraction(b, t), 6).alias("coverage"),
        F.round(I.outside_fraction(b, F.col("tx_span")), 6).alias("outside"), I.sum_to_point(b, at).alias("before"), I.sum_from_point(b, at).alias("behind"),
    )


@query("""select aln_id, string_agg(cast(s as varchar) || '-' || cast(e as varchar), ',' order by s) as introns, count(*) as n from fx_read_introns group by aln_id""")
def i15_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Fixtures(spark, sf_dir).reads().where(F.size("introns") > 0)
    return x.select("aln_id", I.blocks_to_text(F.col("introns")).alias("introns"), F.size("introns").cast("long").alias("n"))


@query("""select tx_id, string_agg(cast(s as varchar) || '-' || cast(e as varchar), ',' order by s) as exons from fx_exons group by tx_id""")
def i16_exons_from_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons rebuilt from introns and span."""
    x = Fixtures(spark, sf_dir).transcripts()
    return x.select("tx_id", I.blocks_to_text(I.exons_from_junctions(F.col("span"), F.col("introns"))).alias("exons"))


@query("""
with b as (select aln_id, s, e, max(q) over (partition by aln_id) as q, min(s) over (partition by aln_id) + 90 as lo, max(e) over (partition by aln_id) - 100 as hi from fx_blocks join fx_aln using (aln_id))
select aln_id, string_agg(cast(greatest(s, lo) as varchar) || '-' || cast(least(e, hi) as varchar), ',' order by s) as kept from b where e > lo and s < hi group by aln_id""")
def i17_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks clipped to a tail on either side."""
    x = Fixtures(spark, sf_dir).reads()
    kept = I.truncate(F.col("blocks"), F.col("s") + 90, F.col("e") - 100)
    return x.withColumn("_k", kept).where(F.size("_k") > 0).select("aln_id", I.blocks_to_text(F.col("_k")).alias("kept"))


@query("""
with p as (select a.tx_id as a, b.tx_id as b, a.gene_id from fx_tx a join fx_tx b on a.gene_id = b.gene_id and a.tx_id < b.tx_id),
x as (select distinct a, b, e.s, e.e from p join fx_exons e on e.tx_id = p.a or e.tx_id = p.b),
m as (select *, case when s <= max(e) over (partition by a, b order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from x),
g as (select a, b, s, e, sum(fresh) over (partition by a, b order by s, e rows unbounded preceding) as k from m),
u as (select a, b, k, min(s) as s, max(e) as e from g group by a, b, k)
select a, b, string_agg(cast(s as varchar) || '-' || cast(e as varchar), ',' order by s) as merged from u group by a, b""")
def i12_merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Fixtures(spark, sf_dir).transcripts()
    p = x.select("gene_id", F.col("tx_id").alias("a"), F.col("exons").alias("xa")).join(x.select("gene_id", F.col("tx_id").alias("b"), F.col("exons").alias("xb")), "gene_id").where("a < b")
    return p.select("a", "b", I.blocks_to_text(I.merge_blocks(F.col("xa"), F.col("xb"))).alias("merged"))


@query("""
with t as (select tx_id, min(s) as lo, max(e) as hi from fx_exons group by tx_id), p as (select tx_id, lo, hi, lo + k * 137 - 50 as pos from t cross join (values (0), (1), (3), (7)) as v(k))
select p.tx_id, p.pos, case when pos < lo or pos > hi then -1 else cast((select count(*) from fx_exons e where e.tx_id = p.tx_id and e.s <= p.pos) as bigint) - 1 end as last_start,
       case when pos < lo or pos > hi then -1 else cast((select count(*) from fx_exons e where e.tx_id = p.tx_id and e.e < p.pos) as bigint) end as first_end from p""")
def i19_interval_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Fixtures(spark, sf_dir).transcripts()
    p = x.withColumn("pos", F.explode(F.array(*[F.col("span.s") + k * 137 - 50 for k in (0, 1, 3, 7)])))
    return p.select("tx_id", "pos", I.find_interval(F.col("exons"), F.col("pos")).cast("long").alias("last_start"), I.find_interval_back(F.col("exons"), F.col("pos")).cast("long").alias("first_end"))


@query("""
with c as (select gene_id, s as cut from fx_exons union select gene_id, e + 1 from fx_exons),
w as (select gene_id, cut as s, lead(cut) over (partition by gene_id order by cut) - 1 as e from c)
select gene_id, s, e from w where e is not null and exists (select 1 from fx_exons x where x.gene_id = w.gene_id and x.s <= w.s and w.e <= x.e)""")
def p3_split_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elementary blocks of each gene."""
    found = R.split_exons(Fixtures(spark, sf_dir).exons(), ["gene_id"])
    # a border that changes nothing (one exon ends where the next begins) still cuts
    return found


@query("""
with m as (select gene_id, tx_id, s, e, case when s <= max(e) over (partition by gene_id order by s, e, tx_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from fx_exons),
g as (select *, sum(fresh) over (partition by gene_id order by s, e, tx_id rows unbounded preceding) as island from m)
select gene_id, cast(island as bigint) as island, min(s) as island_s, max(e) as island_e, count(*) as n from g group by gene_id, island""")
def p4_overlap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.island_bounds(Fixtures(spark, sf_dir).exons(), ["gene_id"]).withColumn("island", F.col("island").cast("long"))


@query("""
with m as (select chr, strand, tx_id, s, e, case when s <= max(e) over (partition by chr, strand order by s, e, tx_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from fx_exons),
g as (select *, sum(fresh) over (partition by chr, strand order by s, e, tx_id rows unbounded preceding) as island from m)
select chr, strand, min(s) as region_s, max(e) as region_e, count(*) as n_exons from g group by chr, strand, island""")
def p5_exon_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.island_bounds(Fixtures(spark, sf_dir).exons(), ["chr", "strand"])
    return found.select("chr", "strand", F.col("island_s").alias("region_s"), F.col("island_e").alias("region_e"), F.col("n").alias("n_exons"))


@query("""
with k as (select distinct x.gene_id, x.s, x.e from fx_exons x where not exists (select 1 from fx_introns i where i.gene_id = x.gene_id and x.s <= i.s and i.e <= x.e)),
m as (select *, case when s <= max(e) over (partition by gene_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from k),
g as (select *, sum(fresh) over (partition by gene_id order by s, e rows unbounded preceding) as island from m)
select gene_id, s, e, min(s) over (partition by gene_id, island) as region_s, max(e) over (partition by gene_id, island) as region_e,
       count(*) over (partition by gene_id, island, s) = 1 as unique_left, count(*) over (partition by gene_id, island, e) = 1 as unique_right from g""")
def p6_splice_site_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per gene: exons that span no intron, in overlap regions, with the uniqueness of their edges."""
    x = Fixtures(spark, sf_dir)
    introns = x.introns().select("gene_id", F.col("s").alias("is_"), F.col("e").alias("ie")).distinct()
    exons = x.exons().select("gene_id", "s", "e").distinct()
    spanning = exons.join(introns, "gene_id").where("s <= is_ and ie <= e").select("gene_id", "s", "e").distinct()
    kept = R.islands(exons.join(spanning, ["gene_id", "s", "e"], "left_anti"), ["gene_id"])
    w = W.partitionBy("gene_id", "island")
    edge = lambda c: F.count("*").over(W.partitionBy("gene_id", "island", c)) == 1
    return kept.select("gene_id", "s", "e", F.min("s").over(w).alias("region_s"), F.max("e").over(w).alias("region_e"), edge("s").alias("unique_left"), edge("e").alias("unique_right"))


@query("""
with f as (select gene_id, chr, strand, s, e, count(distinct tx_id) as n_tx from fx_exons group by gene_id, chr, strand, s, e),
t as (select gene_id, min(s) as gs, max(e) as ge from fx_exons group by gene_id)
select f.gene_id, f.s, f.e, f.s = t.gs or f.e = t.ge as terminal,
       exists (select 1 from f o where o.gene_id = f.gene_id and (o.s <> f.s or o.e <> f.e) and abs(o.s - f.s) <= 12 and abs(o.e - f.e) <= 12) as similar_to,
       exists (select 1 from f o where o.gene_id = f.gene_id and (o.s <> f.s or o.e <> f.e) and o.s <= f.s and f.e <= o.e) as contained,
       case when n_tx = 1 then 'U' else '' end as unique_flag
from f join t on f.gene_id = t.gene_id""")
def p7_feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of distinct exons: terminal, similar to another, contained in another, of one isoform only."""
    x = Fixtures(spark, sf_dir).exons()
    f = x.groupBy("gene_id", "s", "e").agg(F.count_distinct("tx_id").alias("n_tx"))
    o = f.select("gene_id", F.col("s").alias("os"), F.col("e").alias("oe"))
    other = (F.col("os") != F.col("s")) | (F.col("oe") != F.col("e"))
    near = (F.abs(F.col("os") - F.col("s")) <= 12) & (F.abs(F.col("oe") - F.col("e")) <= 12)
    inside = (F.col("os") <= F.col("s")) & (F.col("e") <= F.col("oe"))
    rows = f.join(o, "gene_id").groupBy("gene_id", "s", "e", "n_tx").agg(F.max(other & near).alias("similar_to"), F.max(other & inside).alias("contained"))
    w = W.partitionBy("gene_id")
    return rows.select("gene_id", "s", "e", ((F.col("s") == F.min("s").over(w)) | (F.col("e") == F.max("e").over(w))).alias("terminal"), "similar_to", "contained", F.when(F.col("n_tx") == 1, "U").otherwise("").alias("unique_flag"))


@query("""
with f as (select distinct gene_id, s, e from fx_introns), t as (select gene_id, tx_id, min(s) as ts, max(e) as te from fx_exons group by gene_id, tx_id)
select t.tx_id, string_agg(cast(case when exists (select 1 from fx_introns i where i.tx_id = t.tx_id and i.s = f.s and i.e = f.e) then 1 when f.s >= t.ts and f.e <= t.te then -1 else -2 end as varchar), ',' order by f.s, f.e) as profile
from t join f on t.gene_id = f.gene_id group by t.tx_id""")
def p8_isoform_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intron profile of each isoform over its gene's introns: 1 present, -1 absent inside the transcript, -2 outside."""
    x = Fixtures(spark, sf_dir)
    features = x.introns().groupBy("gene_id").agg(F.array_sort(F.collect_set(I.iv("s", "e"))).alias("features"))
    t = x.transcripts().join(features, "gene_id")
    mark = F.transform("features", lambda f: F.when(F.array_contains("introns", f), 1).when(I.contains(F.col("span"), f), -1).otherwise(-2))
    return t.select("tx_id", F.array_join(F.transform(mark, lambda m: m.cast("string")), ",").alias("profile"))


@query("""
with m as (select chr, s, e, id, case when s <= max(e) over (partition by chr order by s, e, id rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh, read from (
  select chr, s, e, 1 as read, aln_id as id from fx_reads union all select chr, s, e, 0, cast(gene_id as varchar) from fx_genes)),
g as (select *, sum(fresh) over (partition by chr order by s, e, id rows unbounded preceding) as island from m)
select chr, min(s) as region_s, max(e) as region_e, count(*) as n_reads from g where read = 1 group by chr, island""")
def p1_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of overlapping reads, bridged by genes."""
    x = Fixtures(spark, sf_dir)
    return R.regions(x.reads(), x.genes()).drop("island")


@query("""
with b as (select chr, bin, count(*) as n from (select chr, unnest(range(cast(floor(s / 256) as bigint), cast(floor(e / 256) as bigint) + 1)) as bin from fx_reads) group by chr, bin),
w as (select *, max(n) over (partition by chr) as top, lag(n, 1, 1073741824) over (partition by chr order by bin) as b4, lead(n, 1, 1073741824) over (partition by chr order by bin) as af from b)
select chr, bin, n from w where n <= greatest(1, floor(top * 0.2)) and n <= b4 and n <= af""")
def p2_coverage_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 256 bases where a region can be cut."""
    x = Fixtures(spark, sf_dir).reads()
    bins = x.select("chr", F.explode(F.sequence(F.floor(F.col("s") / 256), F.floor(F.col("e") / 256))).alias("bin")).groupBy("chr", "bin").agg(F.count("*").alias("n"))
    return R.coverage_valleys(bins, ["chr"], share=0.2).select("chr", "bin", "n")


@query("""select aln_id from fx_aln where not is_secondary and mapq >= 12""")
def f1_alignment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_alignments(Fixtures(spark, sf_dir).alignments(), 12).select("aln_id")


@query("""select aln_id from fx_aln a join fx_reads r using (aln_id) where not (tag_group = 'N' and n_blocks <= 2 and (is_secondary or mapq < 1))""")
def f2_simple_intergenic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Fixtures(spark, sf_dir)
    rows = x.alignments().select("aln_id", "is_secondary", "mapq", "tag_group").join(x.reads().select("aln_id", "n_blocks"), "aln_id")
    return R.drop_simple_intergenic(rows, F.col("n_blocks"), F.col("tag_group") == "N").select("aln_id")


@query("""
with n as (select aln_id, row_number() over (partition by gene_id order by s, aln_id) - 1 as n, cast(ceil(count(*) over (partition by gene_id) / 40.0) as bigint) as k from fx_reads)
select aln_id from n where n % k = 0""")
def f4_coverage_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th read of a deep gene."""
    return R.every_kth(Fixtures(spark, sf_dir).reads(), ["gene_id"], ["s", "aln_id"], 40).select("aln_id")


@query("""select aln_id from fx_reads where chr in ('chr1', 'chr3')""")
def f5_chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixtures(spark, sf_dir).reads().where(F.col("chr").isin("chr1", "chr3")).select("aln_id")


@query("""select gene_id, tx_id, row_number() over (partition by gene_id order by s, e, tx_id) as nth, s - lag(e) over (partition by gene_id order by s, e, tx_id) as gap from fx_introns""")
def j14_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and gaps of introns of a gene (lag over blocks)."""
    w = W.partitionBy("gene_id").orderBy("s", "e", "tx_id")
    return Fixtures(spark, sf_dir).introns().select("gene_id", "tx_id", F.row_number().over(w).cast("long").alias("nth"), (F.col("s") - F.lag("e").over(w)).alias("gap"))
