"""Transcript discovery: the intron graph as tables of vertices and edges, and the greedy steps inside one locus."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import intervals as I
from ..params import DISCOVERY, Discovery
from .components import components
from .ordering import sweep
from .regions import islands, point_join


def count_introns(introns: DataFrame) -> DataFrame:
    return introns.groupBy("chr", "s", "e").agg(F.count("*").alias("n"))


def intron_edges(reads: DataFrame) -> DataFrame:
    """Consecutive introns of reads, with how often they follow each other."""
    n = F.size("introns")
    pairs = F.zip_with(F.slice("introns", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("introns", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = reads.select("chr", F.explode(pairs).alias("p")).select("chr", "p.a.s", "p.a.e", F.col("p.b.s").alias("ns"), F.col("p.b.e").alias("ne"))
    return rows.groupBy("chr", "s", "e", "ns", "ne").agg(F.count("*").alias("weight"))


def loci(introns: DataFrame, gap: int) -> DataFrame:
    """Numbers groups of introns whose starts lie within gap of each other: greedy steps never reach across."""
    return sweep(introns.withColumn("_s", F.col("s")), ["chr"], "s", "_s", gap, "locus").drop("_s")


def cluster_introns(counts: DataFrame, known: DataFrame, delta: int, least: int) -> DataFrame:
    """Greedy clusters: known introns stand for themselves; others, by falling count, join a similar accepted one (the last by
    coordinates), are accepted if seen `least` times, or go (no representative)."""
    rows = counts.join(known.withColumn("known", F.lit(True)), ["chr", "s", "e"], "full").fillna(False, ["known"]).fillna(0, ["n"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        accepted: list[tuple[int, int]] = []
        out = []
        for r in pdf.sort_values(["known", "n", "s", "e"], ascending=[False, False, True, True]).itertuples(index=False):
            near = [] if r.known else [x for x in accepted if abs(x[0] - r.s) <= delta and abs(x[1] - r.e) <= delta]
            own = r.known or (not near and r.n >= least)
            if own:
                accepted.append((r.s, r.e))
            rep = (r.s, r.e) if own else max(near) if near else (None, None)
            out.append((r.chr, r.s, r.e, r.n, r.known, *rep))
        return pd.DataFrame(out, columns=["chr", "s", "e", "n", "known", "rep_s", "rep_e"]).astype({"rep_s": "Int64", "rep_e": "Int64"})

    schema = "chr string, s bigint, e bigint, n bigint, known boolean, rep_s bigint, rep_e bigint"
    return loci(rows, delta).select("chr", "locus", "s", "e", "n", "known").groupBy("chr", "locus").applyInPandas(lambda pdf: solve(pdf), schema)


def collapse_tips(vertices: DataFrame, edges: DataFrame, p: Discovery = DISCOVERY["default_ont"]) -> DataFrame:
    """(chr, s, e, to_s, to_e): weak introns that share a neighbour with a much stronger, close one give way to it."""
    v = vertices.select("chr", "s", "e", "n")
    strong = v.select("chr", F.col("s").alias("to_s"), F.col("e").alias("to_e"), F.col("n").alias("to_n"))
    after = edges.select("chr", "s", "e", F.struct("ns", "ne").alias("next"))
    before = edges.select("chr", F.col("ns").alias("s"), F.col("ne").alias("e"), F.struct(F.col("s").alias("ns"), F.col("e").alias("ne")).alias("next"))
    ends = after.withColumn("side", F.lit(1)).unionByName(before.withColumn("side", F.lit(0)))
    pair = ends.join(ends.select("chr", "next", "side", F.col("s").alias("to_s"), F.col("e").alias("to_e")), ["chr", "next", "side"])
    near = (F.abs(F.col("s") - F.col("to_s")) <= p.graph_clustering_distance) & (F.abs(F.col("e") - F.col("to_e")) <= p.graph_clustering_distance)
    rows = pair.where(near & ((F.col("s") != F.col("to_s")) | (F.col("e") != F.col("to_e")))).join(v, ["chr", "s", "e"]).join(strong, ["chr", "to_s", "to_e"])
    rows = rows.where(F.col("n") < F.col("to_n") * p.graph_clustering_ratio)
    return rows.groupBy("chr", "s", "e").agg(F.max_by(F.struct("to_s", "to_e"), F.struct("to_n", "to_s", "to_e")).alias("t")).select("chr", "s", "e", "t.to_s", "t.to_e")


def isolated(vertices: DataFrame, edges: DataFrame, p: Discovery = DISCOVERY["default_ont"]) -> DataFrame:
    """Vertices without edges that are too weak against their component's strongest neighbour on the chromosome to stay."""
    ends = edges.select("chr", "s", "e").unionAll(edges.select("chr", "ns", "ne")).distinct()
    alone = vertices.join(ends, ["chr", "s", "e"], "left_anti")
    top = F.max("n").over(W.partitionBy("chr", "locus"))
    return loci(vertices, 1000).withColumn("_top", top).join(alone.select("chr", "s", "e"), ["chr", "s", "e"], "left_semi").where((F.col("n") < p.min_novel_isolated_intron_abs) | (F.col("n") < p.min_novel_isolated_intron_rel * F.col("_top"))).select("chr", "s", "e")


def graph_components(chains: DataFrame) -> DataFrame:
    """(chr, s, e, component) of introns that share a read or transcript; chains hold introns and chr. Consecutive introns of a chain are
    edges, so a chain of n introns gives n of them."""
    vid = lambda x: F.xxhash64("chr", x["s"], x["e"])
    ends = chains.where(F.size("introns") > 0).select("chr", "introns").distinct()
    following = F.transform("introns", lambda x, k: F.struct(x.alias("x"), F.coalesce(F.get("introns", k + 1), x).alias("y")))
    pairs = ends.select("chr", F.explode(following).alias("p"))
    edges = pairs.select(vid(F.col("p.x")).alias("a"), vid(F.col("p.y")).alias("b")).distinct()
    named = pairs.select("chr", "p.x.s", "p.x.e", vid(F.col("p.x")).alias("node")).distinct()
    return named.join(components(edges), "node").drop("node")


def cluster_positions(positions: DataFrame, by: list[str], window: int = 50, least: int = 1, share: float = 0.05) -> DataFrame:
    """Terminal positions (by, pos, n) to clusters: the strongest free position takes all free ones within the window; clusters of
    less than max(least, share of the strongest) reads go. Only positions that are linked by gaps within the window are gathered."""
    kinds = ", ".join(f"`{c}` {positions.schema[c].dataType.simpleString()}" for c in by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = dict(zip(pdf["pos"], pdf["n"], strict=True))
        order = sorted(rest)
        found = []
        for pos in sorted(rest, key=lambda p: (-rest[p], p)):
            if pos in rest:
                near = [p for p in order[bisect_left(order, pos - window) : bisect_right(order, pos + window)] if p in rest]
                found.append((*[pdf[c].iloc[0] for c in by], pos, sum(rest.pop(p) for p in near)))
        return pd.DataFrame(found, columns=[*by, "site", "reads"])

    linked = sweep(positions.withColumn("_p", F.col("pos")), by, "pos", "_p", window, "_linked").drop("_p")
    sites = linked.groupBy(*by, "_linked").applyInPandas(lambda pdf: solve(pdf), f"{kinds}, site bigint, reads bigint")
    top = sites.groupBy(*by).agg(F.max("reads").alias("_top"))
    return sites.join(top, by).where(F.col("reads") >= F.greatest(F.lit(least), F.lit(share) * F.col("_top"))).drop("_top")


def chain_models(reads: DataFrame, transcripts: DataFrame, least: int, least_known: int | None = None) -> DataFrame:
    """Intron chains that at least `least` reads have: known, new combination of known introns, or with a new intron.

    Chains of annotated transcripts need `least_known` reads instead, if it is given."""
    least_known = least if least_known is None else least_known
    chains = reads.where(F.size("introns") > 0).groupBy("gene_id", "chr", "introns").agg(F.count("*").alias("n")).where(F.col("n") >= min(least, least_known))
    known = transcripts.groupBy("gene_id").agg(F.collect_set("introns").alias("_chains"), F.array_distinct(F.flatten(F.collect_list("introns"))).alias("_introns"))
    kind = F.when(F.array_contains("_chains", F.col("introns")), "known").when(F.size(F.array_except("introns", "_introns")) == 0, "NIC").otherwise("NNIC")
    rows = chains.join(known, "gene_id", "left").select("gene_id", "chr", I.blocks_to_text(F.col("introns")).alias("chain"), "n", kind.alias("kind"))
    return rows.where(F.col("n") >= F.when(F.col("kind") == "known", least_known).otherwise(least))


def reference_gene(models: DataFrame, annotation: DataFrame, model: str) -> DataFrame:
    """Annotated gene (ref) with most introns in common; the largest id on ties."""
    shared = models.join(annotation, ["chr", "s", "e"]).groupBy(model, "ref").agg(F.count("*").alias("shared"))
    return shared.groupBy(model).agg(F.max_by(F.struct("ref", "shared"), F.struct("shared", "ref")).alias("b")).select(model, "b.ref", "b.shared")


def shift_mode(rows: DataFrame, by: list[str], gap: str, least: int) -> DataFrame:
    """Most frequent value per group, the smaller of equals, with its count and the group's total."""
    counts = rows.groupBy(*by, gap).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min_by(F.struct(gap, "n"), F.struct(-F.col("n"), F.col(gap))).alias("b"), F.sum("n").alias("total"))
    return best.select(*by, f"b.{gap}", "b.n", "total").where(F.col("n") >= least)


def boundary_deletions(deletions: Column, boundary: Column, within: int = 14) -> Column:
    """Deletions (structs pos, len) near an exon boundary."""
    return F.filter(deletions, lambda d: F.abs(d["pos"] - boundary) <= within)


def join_genes(models: DataFrame, share: float = 0.5) -> DataFrame:
    """Models (tx_id, chr, strand, exons, introns, span, annotated gene or null) into genes, locus by locus: pairs with shared introns
    first (score 1 + Jaccard of introns), then by overlap of spans; best pairs merge first, and never two annotated genes. A locus is a
    row with its models, and Python gets many rows at a time."""

    def solve(chrom: str, strand: str, rows: list[dict]) -> list[tuple]:
        rows.sort(key=lambda r: r["tx_id"])
        group, ref = list(range(len(rows))), {i: r["annotated"] for i, r in enumerate(rows) if r["annotated"] is not None}
        members: dict[int, list[int]] = {i: [i] for i in group}

        def merge(keep: int, gone: int) -> None:
            for i in members[gone]:
                group[i] = keep
            members[keep] += members.pop(gone)

        first: dict[int, int] = {}
        for i, a in list(ref.items()):
            if a in first:
                merge(first[a], i)
                ref.pop(i)
            else:
                first[a] = i
        sets = [{(x["s"], x["e"]) for x in r["introns"]} for r in rows]
        spans = [(r["span"]["s"], r["span"]["e"]) for r in rows]
        pairs = []
        order = sorted(range(len(rows)), key=lambda i: spans[i])
        for n in range(len(order)):
            s, e = spans[order[n]]
            for m in range(n + 1, len(order)):
                if spans[order[m]][0] > e:
                    break
                i, j = min(order[n], order[m]), max(order[n], order[m])
                other = spans[order[m]]
                common = min(e, other[1]) - other[0] + 1
                both = sets[i] & sets[j]
                part = common / min(e - s + 1, other[1] - other[0] + 1)
                if both or part >= share:
                    pairs.append((-(1 + len(both) / len(sets[i] | sets[j])) if both else -part, i, j))
        for _, i, j in sorted(pairs):
            a, b = group[i], group[j]
            if a != b and not (a in ref and b in ref):
                merge(*((a, b) if a in ref or (b not in ref and a < b) else (b, a)))
        return [(r["tx_id"], f"{chrom}_{strand}_{rows[g]['tx_id']}", ref.get(g)) for r, g in zip(rows, group, strict=True)]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for r in batch.to_pylist() for x in solve(r["chr"], r["strand"], r["_m"])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], ["tx_id", "gene", "annotated_gene"])

    spans = models.select("tx_id", "chr", "strand", "introns", "span", F.col("annotated").cast("bigint").alias("annotated"), F.col("span.s").alias("s"), F.col("span.e").alias("e"))
    loci = islands(spans, ["chr", "strand"]).groupBy("chr", "strand", "island").agg(F.collect_list(F.struct("tx_id", "introns", "span", "annotated")).alias("_m"))
    return loci.select("chr", "strand", "_m").mapInArrow(solved, "tx_id bigint, gene string, annotated_gene bigint")


def novel_mono_exons(reads: DataFrame, least: int = 3, window: int = 50) -> DataFrame:
    """Unspliced reads with a tail, by clusters of their tail sites: a model from the smallest start to the site."""
    mono = reads.where((F.size("blocks") == 1) & F.col("tail").isNotNull()).withColumn("_place", F.concat_ws(" ", "chr", "strand"))
    sites = cluster_positions(mono.groupBy("chr", "strand", F.col("tail").alias("pos")).agg(F.count("*").alias("n")), ["chr", "strand"], window, least)
    places = sites.select(F.concat_ws(" ", "chr", "strand").alias("_place"), "site", F.col("site").alias("rs"), F.col("site").alias("re"))
    near = point_join(mono, places, "_place", "tail", window=window)
    return near.groupBy("chr", "strand", "site").agg(F.min(F.col("span.s")).alias("s"), F.max(F.col("span.e")).alias("e"), F.count("*").alias("reads")).where(F.col("reads") >= least)


def coverage_models(matches: DataFrame, least: int, share: float = 0.75) -> DataFrame:
    """Known transcripts without a full-length read: mono-exon ones covered by `share`, others with `least` consistent reads."""
    per = matches.groupBy("tx_id").agg(F.count("*").alias("reads"), F.max("coverage").alias("coverage"), F.max("n_exons").alias("n_exons"))
    return per.where((F.col("reads") >= least) & ((F.col("n_exons") > 1) | (F.col("coverage") >= share)))


def read_categories(reads: DataFrame) -> DataFrame:
    """Final counting of reads on models: unique, shared by several models (equal parts), rejected by the consistency gate, or unassigned."""
    n = F.count("model").over(W.partitionBy("read_id"))
    kind = F.when(F.col("model").isNull(), "unassigned").when(~F.col("consistent"), "rejected").when(n == 1, "unique").otherwise("shared")
    return reads.withColumn("category", kind).withColumn("weight", F.when(kind == "unique", 1.0).when(kind == "shared", F.lit(1.0) / n).otherwise(0.0))


def alternative_ends(models: DataFrame, peaks: DataFrame, apa_delta: int = 50, least: int = 3, share: float = 0.05) -> DataFrame:
    """Sibling models with another 3' end: peaks inside the terminal exon, the first one on -, farther than apa_delta from the end, strong
    enough. models: tx_id, strand, exons; peaks: tx_id, site, reads."""
    minus = F.col("strand") == "-"
    last = F.when(minus, F.element_at("exons", 1)).otherwise(F.element_at("exons", -1))
    end = F.when(minus, last["s"]).otherwise(last["e"])
    top = peaks.groupBy("tx_id").agg(F.max("reads").alias("_top"))
    rows = models.join(peaks, "tx_id").join(top, "tx_id")
    ok = (F.col("site") >= last["s"]) & (F.col("site") <= last["e"]) & (F.abs(F.col("site") - end) > apa_delta) & (F.col("reads") >= F.greatest(F.lit(least), share * F.col("_top")))
    inner = F.when(minus, F.slice("exons", F.lit(2), F.size("exons") - 1)).otherwise(F.slice("exons", F.lit(1), F.size("exons") - 1))
    moved = F.when(minus, F.concat(F.array(I.iv(F.col("site"), last["e"])), inner)).otherwise(F.concat(inner, F.array(I.iv(last["s"], F.col("site")))))
    return rows.where(ok).withColumn("exons", moved).drop("_top")


def deal_to_ends(reads: DataFrame, models: DataFrame, siblings: DataFrame, apa_delta: int = 50) -> DataFrame:
    """(read_id, tx_id, site): each read with the nearest of its model's end and its siblings' ends, the smaller coordinate on ties.
    reads: read_id, tx_id, end; models: tx_id, site; siblings: tx_id, site."""
    sites = models.select("tx_id", "site").unionByName(siblings.select("tx_id", "site")).groupBy("tx_id").agg(F.array_sort(F.collect_set("site")).alias("_s"))
    near = F.array_min(F.transform("_s", lambda s: F.struct(F.abs(s - F.col("end")).alias("d"), s.alias("s"))))["s"]
    return reads.join(sites, "tx_id").select("read_id", "tx_id", near.alias("site"))


def dead_ends(vertices: DataFrame, edges: DataFrame, least: int = 10) -> DataFrame:
    """Introns that only one read took and that lead nowhere, all of whose siblings do likewise, behind (or before) a well covered
    intron. vertices: chr, s, e, n; edges: chr, s, e, ns, ne."""
    out = []
    n_out = edges.groupBy("chr", "s", "e").agg(F.count("*").alias("k"))
    n_in = edges.groupBy("chr", F.col("ns").alias("s"), F.col("ne").alias("e")).agg(F.count("*").alias("k"))
    v = vertices.select("chr", "s", "e", "n")
    for forward, onward in ((True, n_out), (False, n_in)):
        own, other = (("s", "e"), ("ns", "ne")) if forward else (("ns", "ne"), ("s", "e"))
        e = edges.select("chr", F.col(own[0]).alias("fs"), F.col(own[1]).alias("fe"), F.col(other[0]).alias("s"), F.col(other[1]).alias("e"))
        rows = e.join(v, ["chr", "s", "e"]).join(onward, ["chr", "s", "e"], "left").withColumn("_dead", (F.col("n") == 1) & F.col("k").isNull())
        strong = v.where(F.col("n") >= least).select("chr", F.col("s").alias("fs"), F.col("e").alias("fe"))
        whole = rows.groupBy("chr", "fs", "fe").agg(F.min("_dead").alias("_all")).where("_all").join(strong, ["chr", "fs", "fe"], "left_semi")
        out.append(rows.join(whole.select("chr", "fs", "fe"), ["chr", "fs", "fe"], "left_semi").select("chr", "s", "e"))
    return out[0].unionAll(out[1]).distinct()
