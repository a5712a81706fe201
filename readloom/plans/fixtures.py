"""Interval fixtures derived from the TPC-H-like tables: transcripts of genes, alignments with blocks, positions.

Genes are groups of four parts; their transcripts have three or four exons that skip, shift or extend one. Alignments come
from lineitem: a (read) id is not unique, so reads are multi-mapped; aln_id is the row key. SQL over the same definitions
is in VIEWS, for the oracles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators.regions import transcripts as to_transcripts

VIEWS = {
    "fx_exons": """
select cast(p_partkey as bigint) as tx_id, cast(floor(p_partkey / 4) as bigint) as gene_id,
       concat('chr', cast(cast(floor(p_partkey / 4) as bigint) % 5 as varchar)) as chr,
       case when cast(floor(p_partkey / 4) as bigint) % 2 = 0 then '+' else '-' end as strand, cast(k as bigint) as rnk,
       cast(floor(p_partkey / 4) as bigint) * 1500 + 300 * k + 1 + case when p_partkey % 4 = 2 and k = 2 then 12 else 0 end as s,
       cast(floor(p_partkey / 4) as bigint) * 1500 + 300 * k + 120 + case when p_partkey % 4 = 3 and k = 1 then 15 else 0 end as e
from part cross join (values (0), (1), (2), (3)) as r(k)
where not (p_partkey % 4 = 1 and k = 1)""",
    "fx_aln": """
select concat_ws('_', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar), cast(l_suppkey as varchar), cast(cast(l_extendedprice * 100 as bigint) as varchar)) as aln_id,
       concat('r', cast(l_orderkey as varchar), '_', cast(l_linenumber as varchar)) as read_id,
       cast(l_partkey as bigint) as src_tx, cast(floor(l_partkey / 4) as bigint) as gene_id, cast(l_quantity as bigint) as q, cast(l_suppkey % 5 as bigint) - 2 as jit,
       cast(round(l_discount * 600) as bigint) as mapq, l_returnflag = 'R' as is_secondary, l_tax >= 0.04 as polya_found,
       l_returnflag as tag_group, cast(s_nationkey as bigint) as file_group, cast(l_linenumber as bigint) as ln,
       concat('BC', cast(o_custkey as varchar)) as barcode, c_mktsegment as cell_type,
       translate(lpad(cast((o_orderkey * 7919) % 100000000 as varchar), 8, '0'), '0123456789', 'ACGTACGTAC') as umi
from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""",
    "fx_blocks": """
select a.aln_id, a.read_id, a.src_tx, x.gene_id, x.chr, x.strand, x.rnk,
       case when x.rnk = 0 then x.s + a.q else x.s + a.jit end as s,
       case when x.rnk = 3 then x.e - a.q else x.e end as e
from fx_aln a join fx_exons x on a.src_tx = x.tx_id
where not (a.q < 10 and x.rnk = 0) and not (a.q > 40 and x.rnk = 3) and not (a.ln = 7 and x.rnk = 2)""",
    "fx_pos": """
select user_id as tx_id, event_type as grp, cast(floor(value) as bigint) as pos from events""",
    "fx_tx": """
select tx_id, gene_id, chr, strand, min(s) as s, max(e) as e, count(*) as n_exons, list(struct_pack(s := s, e := e) order by s, e) as exons
from fx_exons group by tx_id, gene_id, chr, strand""",
    "fx_genes": """
select gene_id, chr, strand, min(s) as s, max(e) as e from fx_exons group by gene_id, chr, strand""",
    "fx_introns": """
select tx_id, gene_id, chr, strand, s, e from (
  select tx_id, gene_id, chr, strand, e + 1 as s, lead(s) over (partition by tx_id order by s, e) - 1 as e from fx_exons
) where s <= e""",
    "fx_reads": """
select aln_id, read_id, src_tx, gene_id, chr, strand, min(s) as s, max(e) as e, count(*) as n_blocks from fx_blocks group by aln_id, read_id, src_tx, gene_id, chr, strand""",
    "fx_read_introns": """
select aln_id, read_id, gene_id, chr, strand, s, e from (
  select aln_id, read_id, gene_id, chr, strand, e + 1 as s, lead(s) over (partition by aln_id order by s, e) - 1 as e from fx_blocks
) where s <= e""",
}


def with_views(sql: str) -> str:
    """SQL with the fixture views that it needs in front, each once."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(VIEWS[name])
                need.append(name)

    visit(sql)
    if not need:
        return sql
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in need)
    body = sql.strip()
    return f"with {head}, {body[4:]}" if body[:5].lower() == "with " else f"with {head} {body}"


class Fixtures:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def exons(self) -> DataFrame:
        gene = F.floor(F.col("p_partkey") / 4).cast("long")
        # A product, as in the SQL: Spark takes an exploded table for as small as its source, and would broadcast exons and all that is made of them.
        rows = self.table("part").select(F.col("p_partkey").cast("long").alias("tx_id"), gene.alias("gene_id")).crossJoin(self.spark.range(0, 4, 1, 1).select(F.col("id").alias("rnk")))
        kind, g = F.col("tx_id") % 4, F.col("gene_id")
        at = g * 1500 + 300 * F.col("rnk")
        return rows.where(~((kind == 1) & (F.col("rnk") == 1))).select(
            "tx_id", "gene_id", F.concat(F.lit("chr"), (g % 5).cast("string")).alias("chr"), F.when(g % 2 == 0, "+").otherwise("-").alias("strand"), "rnk",
            (at + 1 + F.when((kind == 2) & (F.col("rnk") == 2), 12).otherwise(0)).alias("s"), (at + 120 + F.when((kind == 3) & (F.col("rnk") == 1), 15).otherwise(0)).alias("e"),
        )

    def alignments(self) -> DataFrame:
        joined = self.table("lineitem").join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        text = lambda c: F.col(c).cast("string")
        return joined.select(
            F.concat_ws("_", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("aln_id"),
            F.concat(F.lit("r"), text("l_orderkey"), F.lit("_"), text("l_linenumber")).alias("read_id"), F.col("l_partkey").cast("long").alias("src_tx"), F.floor(F.col("l_partkey") / 4).cast("long").alias("gene_id"),
            F.col("l_quantity").cast("long").alias("q"), ((F.col("l_suppkey") % 5).cast("long") - 2).alias("jit"), F.round(F.col("l_discount") * 600).cast("long").alias("mapq"),
            (F.col("l_returnflag") == "R").alias("is_secondary"), (F.col("l_tax") >= 0.04).alias("polya_found"), F.col("l_returnflag").alias("tag_group"), F.col("s_nationkey").cast("long").alias("file_group"),
            F.col("l_linenumber").cast("long").alias("ln"), F.concat(F.lit("BC"), text("o_custkey")).alias("barcode"), F.col("c_mktsegment").alias("cell_type"),
            F.translate(F.lpad(((F.col("o_orderkey") * 7919) % 100000000).cast("string"), 8, "0"), "0123456789", "ACGTACGTAC").alias("umi"),
        )

    def blocks(self) -> DataFrame:
        x = self.exons().select(F.col("tx_id").alias("src_tx"), "gene_id", "chr", "strand", "rnk", F.col("s").alias("xs"), F.col("e").alias("xe"))
        joined = self.alignments().drop("gene_id").join(x, "src_tx")
        q, rnk = F.col("q"), F.col("rnk")
        kept = joined.where(~((q < 10) & (rnk == 0)) & ~((q > 40) & (rnk == 3)) & ~((F.col("ln") == 7) & (rnk == 2)))
        return kept.select("aln_id", "read_id", "src_tx", "gene_id", "chr", "strand", "rnk", F.when(rnk == 0, F.col("xs") + q).otherwise(F.col("xs") + F.col("jit")).alias("s"), F.when(rnk == 3, F.col("xe") - q).otherwise(F.col("xe")).alias("e"))

    def positions(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("tx_id"), F.col("event_type").alias("grp"), F.floor("value").cast("long").alias("pos"))

    def transcripts(self) -> DataFrame:
        return to_transcripts(self.exons(), ["tx_id", "gene_id", "chr", "strand"])

    def genes(self) -> DataFrame:
        return self.exons().groupBy("gene_id", "chr", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e"))

    def introns(self) -> DataFrame:
        return self.transcripts().select("tx_id", "gene_id", "chr", "strand", F.explode("introns").alias("i")).select("tx_id", "gene_id", "chr", "strand", "i.s", "i.e")

    def reads(self) -> DataFrame:
        """One row per alignment with its blocks and introns."""
        return to_transcripts(self.blocks(), ["aln_id", "read_id", "src_tx", "gene_id", "chr", "strand"]).withColumnsRenamed({"exons": "blocks", "n_exons": "n_blocks"}).withColumn("s", F.col("span.s")).withColumn("e", F.col("span.e"))

    def read_introns(self) -> DataFrame:
        return self.reads().select("aln_id", "read_id", "gene_id", "chr", "strand", F.explode("introns").alias("i")).select("aln_id", "read_id", "gene_id", "chr", "strand", "i.s", "i.e")


