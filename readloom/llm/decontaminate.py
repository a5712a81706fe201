"""Benchmark decontamination, wholly in built-in DataFrame functions.

The windows of the test items (runs of `width` normalised words; an item of fewer words, but not none, is one
window) form a hash set that is broadcast while its counted size stays under a bound. Beyond it the set is shuffled, and
a broadcast bitmap of its hashes keeps nearly all other windows of the corpus out of that shuffle.
Document windows are streamed past the set, each hit is verified on its words, and spans or documents go.

Defined results: null texts have no words; rows that repeat (same id, same text) each get the same result; rows of
one id with different texts are told apart by their texts; null ids are kept; extra columns of either table are
ignored by analyze() and kept by remove_*(); an empty table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import lower_ascii, text_hash

#: Distinct windows that are broadcast at most (some 100 bytes each); more are joined by a shuffle on their hash.
BROADCAST_WINDOWS = 300_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Normalised words of a text; null has none."""
    flat = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), GAP, " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(size, hash, gram, items): one row per distinct window, with the ids of the items that hold it."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.size("w"), F.lit(width)))
    each = w.select("item", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    each = each.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("g"))
    each = each.select("item", "size", F.xxhash64("g").alias("hash"), F.array_join("g", " ").alias("gram")).distinct()
    return each.groupBy("size", "hash", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _bits(windows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(bucket, bits): a bitmap of the windows' hashes, in rows of 32,768 bits, with 16 places per window up to 2**28 places (32 MB)."""
    space = 1 << min(28, max(20, (16 * n - 1).bit_length()))
    place = F.pmod("hash", F.lit(space)) + 1
    return windows.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), space


def _in_bits(at: DataFrame, bits: DataFrame, space: int) -> DataFrame:
    """Rows whose hash has its bit set: none of the windows is lost, and of other rows one in sixteen at most stays while the bitmap has its full share of places."""
    place = F.pmod("hash", F.lit(space)) + 1
    at = at.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "bucket")  # 32 MB at most
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast(floor(bitmap_bit_position(pmod(hash, {space}) + 1) / 8) as int) + 1, 1)")), 16, 10).cast("int")
    return at.where(F.getbit(byte, F.pmod(F.bitmap_bit_position(place), F.lit(8)).cast("int")) == 1).drop("bucket", "bits")


def find_hits(docs: DataFrame, windows: DataFrame, key: list[str], text: str, counts: dict[int, int], small: bool) -> DataFrame:
    """(key, start, size, items) for every occurrence of a window; start counts words from 0. counts: windows of each size.

    A set of windows that is not small is joined by a shuffle on the hash, behind a bitmap of all hashes that is broadcast."""
    sizes = sorted(counts)
    w = docs.select(*key, words(F.col(text)).alias("w")).where(F.size("w") >= min(sizes))
    if len(sizes) == 1:
        n = sizes[0]
        at = w.select(*key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("start"), F.lit(n).alias("size"))
    else:
        at = w.select(*key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - min(sizes))).alias("start"))
        at = at.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(F.col("start") + F.col("size") <= F.size("w"))
    at = at.select(*key, "start", "size", F.slice("w", F.col("start") + 1, F.col("size")).alias("g"))
    at = at.select(*key, "start", "size", "g", F.xxhash64("g").alias("hash"))
    if not small:
        at = _in_bits(at, *_bits(windows, sum(counts.values())))
    found = at.join(F.broadcast(windows) if small else windows.hint("merge"), ["size", "hash"])
    return found.where(F.array_join("g", " ") == F.col("gram")).select(*key, "start", "size", "items")


def _analyze(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """analyze() with the texts' hashes, _t and _t2."""
    windows = item_windows(items, item_id, item_text, width)
    counts = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row per window size, `width` rows at most
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = base.select("doc_id", *text_hash(F.col("text")), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if not counts:
        return base.select("doc_id", "_t", "_t2", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"), F.lit(False).alias("contaminated"), none.alias("item_ids"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))
    key = ["doc_id", "_t", "_t2"]
    keyed = docs.select(F.col(doc_id).alias("doc_id"), *text_hash(F.col(text)), F.col(text).alias("text"))
    hits = find_hits(keyed, windows, key, "text", counts, sum(counts.values()) <= broadcast_windows)
    starts = hits.select(*key, "start", (F.col("start") + F.col("size")).alias("end"), "items")
    order = W.partitionBy(*key).orderBy("start", "end")
    before = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = starts.withColumn("_before", before).withColumn("_run", F.sum(F.when(F.col("start") > F.col("_before"), 1).otherwise(0)).over(order))
    runs = marked.groupBy(*key, "_run").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("found"))
    found = runs.groupBy(*key).agg(
        F.sum(F.col("last") - F.col("first")).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("item_ids"),
        F.array_sort(F.collect_list(F.struct(F.col("first"), (F.col("last") - 1).alias("last")))).alias("spans"),
    )
    rows = base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b._t") == F.col("f._t")) & (F.col("b._t2") == F.col("f._t2")), "left")
    ids = F.coalesce(F.col("item_ids"), none)
    return rows.select(
        F.col("b.doc_id").alias("doc_id"), F.col("b._t").alias("_t"), F.col("b._t2").alias("_t2"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), ids.alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
    )


def analyze(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated, item_ids, spans.

    Options: item_id and item_text (columns of items), width, broadcast_windows."""
    return _analyze(docs, items, doc_id, text, **options).drop("_t", "_t2")


def _join_texts(docs: DataFrame, found: DataFrame, doc_id: str, text: str, how: str) -> DataFrame:
    """docs with what was found for the same id and text; found: _id, _t, _t2 and more."""
    one, two = text_hash(F.col(text))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_t")) & (F.col("_d2") == F.col("_t2"))
    return docs.withColumn("_d", one).withColumn("_d2", two).join(found, same, how).drop("_d", "_d2", "_id", "_t", "_t2")


def remove_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", least_hit: int = 1, least_share: float = 0.0, **options) -> DataFrame:
    """Rows of docs, all columns, without those that have `least_hit` hit words and `least_share` of their words hit. Other texts
    under the id of such a row stay."""
    found = _analyze(docs, items, doc_id, text, **options).where((F.col("n_hit") >= least_hit) & (F.col("n_hit") >= least_share * F.col("n_words")))
    return _join_texts(docs, found.select(F.col("doc_id").alias("_id"), "_t", "_t2").distinct(), doc_id, text, "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of docs, all columns, where `text` loses its hit spans. A contaminated text is rebuilt from its remaining words
    and the gaps that follow them, and stays even if nothing is left of it; other texts stay as they are, byte for byte."""
    found = _analyze(docs, items, doc_id, text, **options).where("contaminated")
    found = found.groupBy(F.col("doc_id").alias("_id"), "_t", "_t2").agg(F.first("spans").alias("_f"))  # rows of one id and text are equal
    joined = _join_texts(docs, found, doc_id, text, "left")
    # pieces: a leading gap, then each word with the gap behind it. Arrays of one struct bind what the inner lambda uses, so it is computed once.
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(1))
    lead = F.regexp_extract(F.col(text), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)

    def rebuilt(x: Column) -> Column:
        return F.array_join(F.filter(x["pieces"], lambda p, i: ~F.exists(x["spans"], lambda s: (s["first"] <= i) & (i <= s["last"]))), "")

    bound = F.array(F.struct(pieces.alias("pieces"), F.col("_f").alias("spans")))
    body = F.when(F.col("_f").isNotNull(), F.concat(lead, F.transform(bound, rebuilt)[0]))
    return joined.withColumn("_body", body).withColumn(text, F.coalesce(F.col("_body"), F.col(text))).drop("_f", "_body")
