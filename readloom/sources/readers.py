"""Sources: annotations, genomes, reads, alignments in SAM text, BED, tables, whitelists, molecule definitions, sample sheets.

All bulk formats are read by Spark's own readers, so any file system that Spark reads will do; gz files too.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import intervals as I

GTF = T.StructType([T.StructField(n, t) for n, t in (("chr", T.StringType()), ("source", T.StringType()), ("feature", T.StringType()), ("s", T.LongType()), ("e", T.LongType()), ("score", T.StringType()), ("strand", T.StringType()), ("frame", T.StringType()), ("attributes", T.StringType()))])


def gtf_attributes(text: Column) -> Column:
    """key -> values of GTF (key "value";) or GFF3 (key=value;) attributes."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(r'([A-Za-z_][\w.]*\s*[= ]\s*(?:"[^"]*"|[^;"]+))'), F.lit(1)), lambda p: F.struct(F.regexp_extract(p, r"^([\w.]+)", 1).alias("k"), F.trim(F.regexp_extract(p, r'^[\w.]+\s*[= ]\s*"?([^"]*)', 1)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda x: x["k"] == k), lambda x: x["v"])))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GTF or GFF3 file with gene_id, transcript_id and all attributes; lines that do not parse are dropped."""
    rows = spark.read.csv(path, sep="\t", comment="#", quote="", schema=GTF).where("s is not null and e is not null and s <= e and feature is not null")
    rows = rows.withColumn("attributes", gtf_attributes(F.coalesce("attributes", F.lit(""))))
    one = lambda k: F.try_element_at("attributes", F.lit(k))[0]
    return rows.withColumn("gene_id", F.coalesce(one("gene_id"), F.when(F.col("feature") == "gene", one("ID")))).withColumn("transcript_id", F.coalesce(one("transcript_id"), one("Parent")))


def rename_duplicates(features: DataFrame, kind: str = "transcript", key: str = "transcript_id") -> DataFrame:
    """Features of one kind whose id occurs at several places get .1, .2, ... in order of position; the first keeps its name."""
    from pyspark.sql import Window as W

    own = features.where(F.col("feature") == kind).select("chr", "s", "e", "strand", key).distinct()
    nth = F.row_number().over(W.partitionBy(key).orderBy("chr", "s", "e", "strand")) - 1
    return own.withColumn("_n", nth).withColumn(f"new_{key}", F.when(F.col("_n") > 0, F.concat_ws(".", F.col(key), F.col("_n").cast("string"))).otherwise(F.col(key))).drop("_n")


def exons_of(gtf: DataFrame) -> DataFrame:
    """Exons as (tx_id, gene_id, chr, strand, s, e), with CDS pieces that touch no exon of their transcript."""
    exon = gtf.where("feature = 'exon'").select(F.col("transcript_id").alias("tx_id"), "gene_id", "chr", "strand", "s", "e")
    cds = gtf.where("feature = 'CDS'").select(F.col("transcript_id").alias("tx_id"), "gene_id", "chr", "strand", "s", "e")
    other = exon.select("tx_id", F.col("s").alias("xs"), F.col("e").alias("xe"))
    lone = cds.join(other, (cds["tx_id"] == other["tx_id"]) & (F.col("s") <= F.col("xe")) & (F.col("xs") <= F.col("e")), "left_anti")
    return exon.unionByName(lone).distinct()


def read_fasta(spark: SparkSession, path: str, tile: int = 1 << 16) -> DataFrame:
    """(chr, tile, start, seq): records cut into tiles, so that a substring needs one or two rows. Lines are joined record by record."""
    records = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    records = records.select(F.regexp_extract("value", r"^(\S+)", 1).alias("chr"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    tiles = records.select("chr", "seq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / tile))).alias("tile"))
    return tiles.select("chr", "tile", (F.col("tile") * tile + 1).alias("start"), F.substr("seq", (F.col("tile") * tile + 1).cast("int"), F.lit(tile)).alias("seq"))


def fetch(regions: DataFrame, tiles: DataFrame, tile: int = 1 << 16) -> DataFrame:
    """Adds seq of closed regions (chr, s, e), joined from tiles."""
    keyed = regions.withColumn("_id", F.xxhash64("chr", "s", "e"))
    spots = keyed.select("_id", "chr", "s", "e").distinct().withColumn("tile", F.explode(F.sequence(F.floor((F.col("s") - 1) / tile), F.floor((F.col("e") - 1) / tile))))
    from_ = F.greatest(F.col("s"), F.col("start"))
    part = F.expr("substring(seq, cast(greatest(s, start) - start + 1 as int), cast(least(e, start + length(seq) - 1) - greatest(s, start) + 1 as int))")
    parts = spots.join(tiles, ["chr", "tile"]).select("_id", F.struct(from_.alias("at"), part.alias("p")).alias("x"))
    whole = parts.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "").alias("seq"))
    return keyed.join(whole, "_id", "left").drop("_id")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq, quality) of four-line records. Files may be split: lines are numbered from the place of their split in the file,
    with one row per split in the sums, so a record may begin in one split and end in the next."""
    from pyspark.sql import Window as W

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"]).withColumn("line", F.col("before") + F.col("id") - F.col("first"))
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    rows = numbered.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(part(0).alias("name"), part(1).alias("seq"), part(3).alias("quality"))
    return rows.select(F.regexp_extract("name", r"^@(\S+)", 1).alias("read_id"), "seq", "quality")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text: fields, flags and tags as a map."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    flag = F.get("f", F.lit(1)).try_cast("int")
    tags = F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0)))
    return lines.select(
        F.get("f", F.lit(0)).alias("read_id"), flag.alias("flag"), F.get("f", F.lit(2)).alias("chr"), F.get("f", F.lit(3)).try_cast("bigint").alias("pos"), F.get("f", F.lit(4)).try_cast("int").alias("mapq"), F.get("f", F.lit(5)).alias("cigar"), F.get("f", F.lit(9)).alias("seq"),
        (flag.bitwiseAND(4) != 0).alias("unmapped"), (flag.bitwiseAND(256) != 0).alias("is_secondary"), (flag.bitwiseAND(2048) != 0).alias("is_supplementary"), F.when(flag.bitwiseAND(16) != 0, "-").otherwise("+").alias("aligned_strand"),
        F.map_from_arrays(F.transform(tags, lambda t: F.substring(t, 1, 2)), F.transform(tags, lambda t: F.regexp_extract(t, r"^[^:]*:[^:]*:(.*)$", 1))).alias("tags"),
    )


def cigar_blocks(pos: Column, cigar: Column) -> Column:
    """Exon blocks of an alignment: M, =, X and D extend a block, N splits, and a block stays only if it holds a match."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda o: F.struct(F.regexp_extract(o, r"^(\d+)", 1).cast("bigint").alias("n"), F.right(o, F.lit(1)).alias("op")))
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    start = F.struct(pos.cast("bigint").alias("at"), pos.cast("bigint").alias("from"), F.lit(False).alias("hit"), empty.alias("done"))

    def step(a: Column, o: Column) -> Column:
        closed = F.when(a["hit"], F.concat(a["done"], F.array(I.iv(a["from"], a["at"] - 1)))).otherwise(a["done"])
        moves = o["op"].isin("M", "=", "X", "D")
        n = o["op"] == "N"
        at = F.when(moves | n, a["at"] + o["n"]).otherwise(a["at"])
        return F.struct(at.alias("at"), F.when(n, at).otherwise(a["from"]).alias("from"), F.when(n, F.lit(False)).otherwise(a["hit"] | o["op"].isin("M", "=", "X")).alias("hit"), F.when(n, closed).otherwise(a["done"]).alias("done"))

    return F.aggregate(F.concat(ops, F.array(F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("N").alias("op")))), start, step, lambda a: a["done"])


def merge_sources(frames: list[DataFrame], by: str = "chr") -> DataFrame:
    """Alignments of several files as one, in ranges of (chr, s) and sorted inside them; the file number is kept."""
    tagged = [f.withColumn("file_group", F.lit(k)) for k, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.repartitionByRange(by, "s").sortWithinPartitions(by, "s", "e")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chr, s, e, name, score, strand) with 1-based closed intervals."""
    rows = spark.read.csv(path, sep="\t", comment="#")
    name = lambda k, alias: (F.col(f"_c{k}") if f"_c{k}" in rows.columns else F.lit(None).cast("string")).alias(alias)
    return rows.select(F.col("_c0").alias("chr"), (F.col("_c1").cast("bigint") + 1).alias("s"), F.col("_c2").cast("bigint").alias("e"), name(3, "name"), name(4, "score"), name(5, "strand"))


def read_groups(spark: SparkSession, path: str, read_column: int = 0, group_columns: tuple[int, ...] = (1,), sep: str = "\t") -> DataFrame:
    """(read_id, group...) of a table without header."""
    rows = spark.read.csv(path, sep=sep, comment="#")
    return rows.select(F.col(f"_c{read_column}").alias("read_id"), *[F.col(f"_c{c}").alias("group" if len(group_columns) == 1 else f"group_{k}") for k, c in enumerate(group_columns)])


def read_barcoded_reads(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, barcode, umi) of a table of three or more columns."""
    rows = spark.read.csv(path, sep="\t", comment="#")
    return rows.select(F.col("_c0").alias("read_id"), F.col("_c1").alias("barcode"), F.col("_c2").alias("umi"))


def barcode_tags(alignments: DataFrame, barcode: str = "CB", umi: str = "UB", strip_suffix: bool = True) -> DataFrame:
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    code = F.regexp_replace(tag(barcode), r"-[^-]*$", "") if strip_suffix else tag(barcode)
    return alignments.withColumn("barcode", code).withColumn("umi", tag(umi))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.regexp_extract("value", r"^(\S+)", 1)).alias("barcode")).where("barcode != ''").distinct()


def short_read_introns(alignments: DataFrame) -> DataFrame:
    """(chr, s, e, n): introns of short-read alignments with their counts over all files."""
    rows = alignments.select("chr", F.explode(I.junctions(cigar_blocks(F.col("pos"), F.col("cigar")))).alias("i"))
    return rows.groupBy("chr", "i.s", "i.e").agg(F.count("*").alias("n"))


def parse_molecule(text: str) -> list[dict]:
    """Elements of a molecule definition: a layout line A:B:C, then a line of name, type and value (and length) for each."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    order = lines[0].split(":")
    found = {}
    for line in lines[1:]:
        name, kind, *rest = re.split(r"\s+", line)
        numbers = [int(x) for x in rest if x.isdigit()]
        found[name] = {"name": name, "kind": "VAR" if kind.startswith("VAR") else kind, "type": kind, "seq": rest[0] if kind == "CONST" else None, "source": next((x for x in rest if not x.isdigit()), None) if kind != "CONST" else None, "length": numbers[-1] if numbers else len(rest[0]) if kind == "CONST" else None}
    missing = [n for n in order if n not in found and n.lower() not in ("cdna", "polyt")]
    if missing:
        raise ValueError(f"undefined elements: {', '.join(missing)}")
    return [found.get(n, {"name": n, "kind": "cDNA" if n.lower() == "cdna" else "PolyT", "type": n, "seq": None, "source": None, "length": None}) for n in order]


def parse_samples(text: str) -> list[dict]:
    """Samples of a sheet in JSON, or in the plain YAML subset of such sheets: a list of mappings with scalar or list values."""
    try:
        rows = json.loads(text)
    except ValueError:
        rows = []
        key = None
        for line in text.splitlines():
            body = line.split("#")[0].rstrip()
            flat = body.strip().strip(",[]{}").strip()
            if not flat:
                continue
            item = re.match(r"^\s*-\s*(.*)$", body)
            pair = re.match(r"""^(?:-\s*)?["']?([\w ]+?)["']?\s*:\s*(.*?),?$""", body.strip().lstrip("{").strip())
            if pair and not (item and key and ":" not in flat):
                if item or body.strip().startswith("{") or not rows or pair[1] in rows[-1]:
                    rows.append({})
                key, value = pair[1], pair[2].strip().strip("[]").strip("\"' ")
                rows[-1][key] = value or []
            elif rows and key:
                value = flat.lstrip("- ").strip("\"', ")
                rows[-1][key] = [*([] if rows[-1][key] == [] else rows[-1][key] if isinstance(rows[-1][key], list) else [rows[-1][key]]), value]
    samples = [r for r in rows if "name" in r or "long read files" in r]
    names = [r.get("name") for r in samples]
    if len(set(names)) != len(names):
        raise ValueError("sample names repeat")
    for r in samples:
        files = r.get("long read files", [])
        r["long read files"] = files if isinstance(files, list) else [files]
        if len(set(r["long read files"])) != len(r["long read files"]):
            raise ValueError(f"files of {r.get('name')} repeat")
    return samples


def cached(spark: SparkSession, df: DataFrame, folder: str, key: str) -> DataFrame:
    """A table kept as Parquet under a key (such as path and time of change); read if it is there."""
    path = f"{folder.rstrip('/')}/{re.sub(r'[^A-Za-z0-9_.-]', '_', key)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replay(spark: SparkSession, folder: str, stage: str, dropped: DataFrame | None = None, key: str = "read_id") -> DataFrame:
    """Rows of a stage that an earlier run saved, without reads that later stages dropped (suspended or filtered ones)."""
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{stage}")
    return rows if dropped is None else rows.join(dropped.select(key).distinct(), key, "left_anti")


def save_stage(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """A stage's rows as Parquet, read back for what follows; later runs can replay() it."""
    path = f"{folder.rstrip('/')}/{stage}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def region_reads(alignments: DataFrame, regions: DataFrame, in_memory: bool = False) -> DataFrame:
    """Alignments of regions (chr, rs, re). Regions that are asked for again come from the scan, or from storage that spills to disk."""
    from pyspark import StorageLevel

    from ..operators.regions import interval_join

    rows = alignments.persist(StorageLevel.MEMORY_AND_DISK) if in_memory else alignments
    return interval_join(rows, regions)


def joined_blocks(pos: Column, cigar: Column) -> Column:
    """Blocks of an alignment where pieces of matches that only insertions or deletions separate are one: as cigar_blocks(), but blocks
    begin and end with a match, so deletions at their edges belong to none."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda o: F.struct(F.regexp_extract(o, r"^(\d+)", 1).cast("bigint").alias("n"), F.right(o, F.lit(1)).alias("op")))
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    start = F.struct(pos.cast("bigint").alias("at"), F.lit(True).alias("fresh"), empty.alias("done"))

    def step(a: Column, o: Column) -> Column:
        match, skip = o["op"].isin("M", "=", "X"), o["op"] == "N"
        at = F.when(match | skip | (o["op"] == "D"), a["at"] + o["n"]).otherwise(a["at"])
        own = I.iv(a["at"], at - 1)
        last = F.try_element_at(a["done"], F.lit(-1))
        longer = F.concat(F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.array(I.iv(last["s"], own["e"])))
        done = F.when(match & a["fresh"], F.concat(a["done"], F.array(own))).when(match, longer).otherwise(a["done"])
        return F.struct(at.alias("at"), F.when(match, F.lit(False)).when(skip, F.lit(True)).otherwise(a["fresh"]).alias("fresh"), done.alias("done"))

    return F.aggregate(ops, start, step, lambda a: a["done"])


def validated(gtf: DataFrame) -> DataFrame:
    """Features whose gene or transcript ids repeat at several places, each with an id of its own there (see rename_duplicates); exons
    follow the transcript whose place holds them."""
    names = rename_duplicates(gtf).select("transcript_id", "new_transcript_id", F.col("chr").alias("_c"), F.col("strand").alias("_st"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    rows = gtf.join(names, "transcript_id", "left").where("feature = 'gene' or new_transcript_id is null or (chr = _c and strand = _st and s >= _s and e <= _e)")
    return rows.withColumn("transcript_id", F.coalesce("new_transcript_id", "transcript_id")).drop("new_transcript_id", "_c", "_st", "_s", "_e")
