"""N-gram Jaccard join: MinHash banding proposes pairs, full shingle sets decide them.

1. One pass over the texts gives, per document, a class hash (its normalised words), a MinHash signature and the band
   hashes. Bands and rows are chosen so that a pair at the threshold shares a band with probability `recall`.
2. Copies collapse into classes; from here on everything is about classes (nodes).
3. Classes that share a band hash meet in a bucket. In a bucket of more than `bucket_block` members, rounds with a leader
   take out what resembles the leader (a partial aggregate and a join, so no task holds the bucket); what stays, and
   every small bucket, is compared signature by signature, in blocks. Estimates well below the threshold still connect.
4. Connected proposals form candidate groups. Shingle sets meet once per pair of blocks of a candidate group, and all
   pairs of blocks are decided on the full sets; a task returns link counts and a spanning forest, never the pairs.

Defined results: a text of fewer words than the shingle width, but not none, has one shingle; null, empty and wordless
texts link with nothing and are their own class; repeated rows are copies and count as links; a class id is the smallest
id of the class (null only if all its ids are null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop_tables, grouped, lean, materialize, mix64, prefix_hash, shingle_hashes, text_bytes, text_hash, window_hash, word_hashes
from .components import connected_components

_SEEDS = np.random.default_rng(77).integers(1, 2**63, size=512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Signature estimates from here on connect two classes to one candidate group, and from LEADER on a class resembles a leader.
CONNECT_BELOW, LEADER = 0.35, 0.8


def choose_bands(threshold: float, recall: float, most_hashes: int = 192) -> tuple[int, int]:
    """(bands, rows): the most selective banding within the hash budget that finds a pair at the threshold with this probability."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most_hashes or best is None:
            best = (bands, rows)
    return best


def _identity(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of runs of words."""
    return window_hash(prefix_hash(words), begins, ends).view(np.int64), window_hash(prefix_hash(mix64(words ^ _SEEDS[511])), begins, ends).view(np.int64)


def _featurize(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw, offsets = text_bytes(batch.column("text"))
                words, bounds = word_hashes(raw, offsets)
                shingles, sb = shingle_hashes(words, bounds, width)
                full = np.flatnonzero(np.diff(sb))
                n = len(bounds) - 1
                h1, h2 = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                h1[full], h2[full] = _identity(words, bounds[:-1][full], bounds[1:][full])
                least = np.empty((len(full), bands * rows), dtype=np.uint64)
                if len(full):
                    starts = sb[:-1][full]
                    for k in range(bands * rows):
                        np.minimum.reduceat(shingles * _SEEDS[k], starts, out=least[:, k])
                least = mix64(least)
                sig = (least & np.uint64(255)).astype(np.uint8)
                band = np.empty((len(full), bands), dtype=np.uint64)
                for b in range(bands):
                    part = np.full(len(full), _SEEDS[300 + b])
                    for r in range(rows):
                        part = mix64(part + least[:, b * rows + r])
                    band[:, b] = part
                none = np.ones(n, dtype=bool)
                none[full] = False
                lists, sigs = np.zeros(n, dtype=np.int32), [None] * n
                lists[full] = bands
                for i, row in zip(full.tolist(), sig, strict=True):
                    sigs[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "_t", "_t2")), pa.array(h1, mask=none), pa.array(h2, mask=none), pa.array(np.diff(sb).astype(np.int64)), pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lists))).astype(np.int32), pa.array(band.view(np.int64).ravel())), pa.array(sigs, pa.binary())],
                    ["doc_id", "_t", "_t2", "h1", "h2", "n_shingles", "bands", "sig"],
                )

    return run


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Star edges with the components of the pairs (a, b) of nodes."""
    ids, inverse = np.unique(nodes, return_inverse=True)
    label = _local_components(len(ids), inverse[a], inverse[b]) if len(a) else np.arange(len(ids))
    far = label != np.arange(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], ["a", "b"])


def _sigs(column: pa.Array) -> np.ndarray:
    items = column.to_pylist()
    return np.frombuffer(b"".join(items), dtype=np.uint8).reshape(len(items), -1) if items else np.zeros((0, 1), np.uint8)


def _estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    same = (x == y).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _small_buckets(connect: float, most: int):
    """All pairs within buckets of at most `most` members, over a partition sorted by bucket: pairs at distance 1, 2, ... in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([keep, table]).combine_chunks() if keep is not None else table
            bucket, node, sig = np.asarray(table.column("bh")), np.asarray(table.column("node")), _sigs(table.column("sig"))
            found_a, found_b = [], []
            for d in range(1, most):
                i = np.flatnonzero(bucket[:-d] == bucket[d:]) if d < len(bucket) else []
                if not len(i):
                    break
                for at in range(0, len(i), 20000):
                    p = i[at : at + 20000]
                    p = p[_estimate(sig[p], sig[p + d]) >= connect]
                    found_a.append(p)
                    found_b.append(p + d)
            if found_a:
                yield _stars(node, np.concatenate(found_a), np.concatenate(found_b))
            keep = table.slice(max(0, len(bucket) - most))  # a bucket may go on in the next batch

    return run


def _block_buckets(connect: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["bh", "i", "j"]):
            node, sig = np.asarray(table.column("node")), _sigs(table.combine_chunks().column("sig"))
            pairs = [(k, np.flatnonzero(_estimate(sig[k + 1 :], sig[k]) >= connect) + k + 1) for k in range(len(node))]
            a = np.concatenate([np.full(len(q), k) for k, q in pairs] or [np.zeros(0, int)]).astype(np.int64)
            yield _stars(node, a, np.concatenate([q for _, q in pairs]).astype(np.int64) if len(a) else a)

    return run


def _resemble_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        est = _estimate(_sigs(batch.column("sig")), _sigs(batch.column("leader_sig"))) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("bh", "node", "sig", "leader")), pa.array(est, pa.float64())], ["bh", "node", "sig", "leader", "est"])


def _block_pairs(df: DataFrame, size: str, block: int, key: str) -> DataFrame:
    """One copy of each row for each pair (i, j) of blocks of its group that it belongs to; i <= j."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(key, F.lit("block")), blocks).cast("int")
    df = df.withColumn("_n", blocks).withColumn("_mine", mine)
    other = df.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"))
    return other.select("*", F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j")).drop("_n", "_other")


def _propose(nodes: DataFrame, connect: float, block: int) -> DataFrame:
    """(a, b): edges whose components are the candidate groups. nodes: (node, bands, sig)."""
    members = nodes.select("node", F.explode("bands").alias("bh"))
    counts = members.groupBy("bh").agg(F.count("*").alias("n")).where("n > 1")
    multi = members.join(counts.hint("merge"), "bh").join(nodes.select("node", "sig").hint("merge"), "node").select("bh", "node", "sig", "n")
    multi = materialize(multi, "buckets")
    small = multi.where(F.col("n") <= block).select("bh", "node", "sig")
    edges = [small.repartition("bh").sortWithinPartitions("bh", "node").mapInArrow(lean(_small_buckets(connect, block), whole=True), "a long, b long")]
    rest = multi.where(F.col("n") > block).select("bh", "node", "sig")
    for _ in range(4):
        if rest.isEmpty():
            break
        leaders = rest.groupBy("bh").agg(F.min("node").alias("leader"), F.count("*").alias("_n")).where(F.col("_n") > 1)
        leaders = leaders.join(nodes.select(F.col("node").alias("leader"), F.col("sig").alias("leader_sig")).hint("merge"), "leader")
        seen = rest.join(leaders.hint("merge"), "bh").select("bh", "node", "sig", "leader", "leader_sig").mapInArrow(_resemble_leader, "bh long, node long, sig binary, leader long, est double")
        seen = materialize(seen, "leaders")
        edges.append(seen.where((F.col("est") >= connect) & (F.col("node") != F.col("leader"))).select(F.col("node").alias("a"), F.col("leader").alias("b")))
        rest = seen.where((F.col("est") < LEADER) & (F.col("node") != F.col("leader"))).select("bh", "node", "sig")
    sizes = rest.groupBy("bh").agg(F.count("*").alias("n")).where("n > 1")
    dealt = _block_pairs(rest.join(sizes.hint("merge"), "bh"), "n", block, "node").select("bh", "i", "j", "node", "sig")
    edges.append(dealt.repartition("bh", "i", "j").sortWithinPartitions("bh", "i", "j", "node").mapInArrow(lean(_block_buckets(connect), whole=True), "a long, b long"))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionAll(e)
    return out


def _shingle_sets(width: int):
    """Texts to sorted distinct shingle hashes; rows whose text is not the class's (an id that two texts share) go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = word_hashes(*text_bytes(batch.column("text")))
            shingles, sb = shingle_hashes(words, bounds, width)
            h1, h2 = _identity(words, bounds[:-1], bounds[1:])
            fits = (h1 == np.asarray(batch.column("h1"))) & (h2 == np.asarray(batch.column("h2")))
            sets = [np.unique(shingles[sb[k] : sb[k + 1]]).tobytes() if fits[k] else None for k in range(batch.num_rows)]
            keep = pa.array(fits)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("node", "comp", "size", "weight")] + [pa.array(sets, pa.binary()).filter(keep)], ["node", "comp", "size", "weight", "set"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of sorted sets, by slabs of the shingles that at least two of them hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    use = counts[inverse] > 1
    owner, column = owner[use], column[inverse[use]]
    total = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    slab = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, slab):
        a, b = np.searchsorted(column, (at, at + slab))
        m = np.zeros((len(sets), slab), dtype=np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        total += m @ m.T
    return total


def _decide(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["comp", "i", "j"]):
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            node, first = np.unique(np.asarray(table.column("node")), return_index=True)
            raw = table.column("set").to_pylist()
            sets = [np.frombuffer(raw[k], dtype=np.uint64) for k in first]
            mine, weight = np.asarray(table.column("mine"))[first], np.asarray(table.column("weight"))[first]
            both = overlaps(sets)
            length = np.array([len(s) for s in sets], dtype=float)
            linked = both >= threshold * (length[:, None] + length[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= mine[:, None] != mine[None, :]
            a, b = np.nonzero(linked)
            root = node[_local_components(len(node), a, b)]
            links = linked @ weight
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(root[some]), pa.array(links[some].astype(np.int64))], ["node", "root", "links"])

    return run


def _near_duplicates(docs: DataFrame, doc_id: str, text: str, width: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 96, most_hashes: int = 192) -> DataFrame:
    """near_duplicates() with the texts' hashes (_t, _t2) and the component, which names a class whatever its ids are."""
    bands, rows = choose_bands(threshold, recall, most_hashes)
    kind = docs.schema[doc_id].dataType.simpleString()
    plain = docs.select(F.col(doc_id).alias("doc_id"), *text_hash(F.col(text)), F.col(text).alias("text"))
    marked = materialize(plain.mapInArrow(lean(_featurize(width, bands, rows)), f"doc_id {kind}, _t long, _t2 int, h1 long, h2 long, n_shingles long, bands array<long>, sig binary"), "minhash")
    # Classes of equal words, told apart by 128 bits; in the written table each has a number of its own.
    nodes = marked.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("weight"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "classes")
    connect = threshold - CONNECT_BELOW
    groups = connected_components(_propose(nodes, connect, block), label="candidates")
    groups = materialize(groups.withColumnRenamed("component", "comp"), "groups")
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size"))
    wanted = groups.join(sizes.hint("merge"), "comp").join(nodes.select("node", "h1", "h2", "first_id", "weight").hint("merge"), "node")
    texts = plain.where("doc_id is not null").join(wanted.where("first_id is not null").hint("merge"), F.col("doc_id") == F.col("first_id")).select("node", "h1", "h2", "comp", "size", "weight", "text")
    unnamed = wanted.where("first_id is null")
    if not unnamed.isEmpty():  # classes all of whose ids are null: their texts are found by hash
        hashed = plain.where("doc_id is null").select("text").mapInArrow(lean(_with_hashes), "h1 long, h2 long, text string").dropDuplicates(["h1", "h2"]).join(unnamed.hint("merge"), ["h1", "h2"])
        texts = texts.unionAll(hashed.select("node", "h1", "h2", "comp", "size", "weight", "text"))
    sets = texts.mapInArrow(lean(_shingle_sets(width)), "node long, comp long, size long, weight long, set binary")
    dealt = _block_pairs(sets, "size", block, "node").select("comp", "i", "j", F.col("_mine").alias("mine"), "node", "weight", "set")
    decided = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(lean(_decide(threshold), whole=True), "node long, root long, links long")
    decided = materialize(decided, "links")
    final = connected_components(decided.select(F.col("node").alias("a"), F.col("root").alias("b")), label="classes")
    links = decided.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.select("node", "h1", "h2", "first_id", "weight").join(links.hint("merge"), "node", "left").join(final.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = info.groupBy("component").agg(F.min("first_id").alias("class_id"))
    info = info.join(firsts.hint("merge"), "component").select("node", "h1", "h2", "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    info = materialize(info, "classed")
    drop_tables(decided, groups, nodes)
    out = marked.select("doc_id", "_t", "_t2", "h1", "h2", "n_shingles").join(info.hint("merge"), ["h1", "h2"], "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles", "node", "component", "_t", "_t2")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of docs: doc_id, class_id, n_links (other rows at or above the threshold), n_shingles, node (number of its class of equal words).

    Options: width, threshold, recall, block (members compared in one task), most_hashes."""
    return _near_duplicates(docs, doc_id, text, **options).drop("component", "_t", "_t2")


def _with_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, bounds = word_hashes(*text_bytes(batch.column("text")))
        h1, h2 = _identity(words, bounds[:-1], bounds[1:])
        yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column("text")], ["h1", "h2", "text"])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of docs, all columns, with one document of each class: that with the smallest id (of its texts under this id, that with
    the least hash). Of repeated rows (same id, same text) one stays; rows with null ids stay, and so does a text that resembles
    nothing, whatever other texts share its id."""
    found = materialize(_near_duplicates(docs, doc_id, text, **options).where("n_links > 0 and doc_id is not null").groupBy("doc_id", "_t", "_t2").agg(F.first("component").alias("component"), F.first("class_id").alias("class_id")), "linked")
    heads = found.where("doc_id = class_id").groupBy("component").agg(F.min(F.struct("doc_id", "_t", "_t2")).alias("head"))
    flags = found.join(heads.hint("merge"), "component", "left").select(F.col("doc_id").alias("_id"), "_t", "_t2", F.coalesce(F.struct("doc_id", "_t", "_t2") == F.col("head"), F.lit(False)).alias("_head"))
    one, two = text_hash(F.col(text))
    same = (F.col(doc_id) == F.col("_id")) & (F.col("_d") == F.col("_t")) & (F.col("_d2") == F.col("_t2"))
    joined = docs.withColumn("_d", one).withColumn("_d2", two).join(flags.hint("merge"), same, "left")
    nth = F.row_number().over(W.partitionBy(doc_id, "_d", "_d2").orderBy("_id"))
    return joined.withColumn("_nth", F.when(F.col("_id").isNull(), 1).otherwise(nth)).where("_id is null or (_head and _nth = 1)").drop("_id", "_head", "_nth", "_d", "_d2", "_t", "_t2")
