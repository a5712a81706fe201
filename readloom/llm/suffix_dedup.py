"""Repeated passages by a run-length Burrows-Wheeler index over what can repeat.

A byte goes if a `length`-byte string that covers it also starts anywhere else (same text or another; strings never cross
texts). Indexing every suffix of a corpus in one place does not scale, so strings are first dealt by content:

1. Each `length`-byte string has an anchor, the leftmost of the least k-gram hashes in it. Equal strings have equal
   anchors, so they meet under one key wherever they are. Neighbouring strings with one anchor form a unit; a unit that
   is seen twice, byte for byte, is repeated as a whole, which settles copies with counts alone.
2. Under keys that hold different units, the distinct units (one copy of each) are indexed: suffix order, the transform
   in runs, and suffix samples at run ends. Inside a run the preceding byte agrees, so the longest match of a suffix is
   that of its successor in the text plus one; only at run ends must it be measured. Streaming from the samples, every
   match of `length` or more is marked, and nothing else is.
3. A key with very many different units (the edge of a passage that a third of all texts share) is never gathered: its
   units are cut into shorter blocks of strings, dealt again by the bytes that all strings of a block have in common,
   and counted; down to single strings, where counting is exact.

Defined results: null and empty texts have no bytes and lose none; texts shorter than `length` lose none; repeated rows
are each other's repeats; null ids are kept; a cut may fall inside a character (the kept bytes are exact; as text such
bytes are dropped from the kept text). Texts are told apart by 96 bits of hashes, units by 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _TABLE, drop_tables, grouped, lean, materialize, mix64, prefix_hash, slices, text_bytes, text_hash, window_hash

LENGTH, GRAM = 400, 32
#: Different units that are indexed under one key at most; keys with more are cut into blocks of these sizes.
MOST_UNITS, BLOCKS = 64, (46, 6, 1)
#: Bytes that are hashed, and indexed, at a time.
CHUNK, INDEX_BYTES = (1 << 18) - 4096, 1 << 18
_POSITION = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by blocks: two running minima and one comparison each."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def units_of(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, key, digest, first start in the text, number of starts, anchor's distance from the first start) of every unit."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return (none,) * 6
    sums = prefix_hash(_TABLE[raw])
    at = np.arange(len(raw) - gram + 1)
    grams = window_hash(sums, at, at + gram)
    least = sliding_min((grams & ~_POSITION) | (at.astype(np.uint64) & _POSITION), length - gram + 1)
    anchor = (least & _POSITION).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(bounds, starts, side="right") - 1
    valid = starts + length <= bounds[text + 1]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    heads = np.flatnonzero(new & valid)
    if not len(heads):
        return (none,) * 6
    stops = np.flatnonzero(np.concatenate((new | ~valid, [True])))
    counts = stops[np.searchsorted(stops, heads, side="right")] - heads
    p = anchor[heads]
    return text[heads], grams[p].view(np.int64), window_hash(sums, heads, heads + counts + length - 1).view(np.int64), heads - bounds[text[heads]], counts, p - heads


def _segments(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of whole texts: bytes, bounds, row, offset in the text. A longer text comes in segments that overlap by length - 1."""
    raw, offsets = text_bytes(column)
    rows, starts, ends = [], [], []
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        for s in range(a, max(a + 1, b - length + 1), CHUNK):
            rows.append(k)
            starts.append(s)
            ends.append(min(b, s + CHUNK + length - 1))
    i = 0
    while i < len(rows):
        j, size = i, 0
        while j < len(rows) and (j == i or size + ends[j] - starts[j] <= CHUNK):
            size += ends[j] - starts[j]
            j += 1
        parts = [raw[starts[k] : ends[k]] for k in range(i, j)]
        yield np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), np.array(rows[i:j]), np.array(starts[i:j]) - offsets[np.array(rows[i:j])]
        i = j


def _emit_units(length: int, gram: int):
    """Per segment of a text and unit content: (t, t2, key, digest, n, a, spots), where spots are the starts of the unit in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, names2 = np.asarray(batch.column("t")), np.asarray(batch.column("t2"))
            for raw, bounds, rows, shift in _segments(batch.column("text"), length):
                text, key, digest, first, n, a = units_of(raw, bounds, length, gram)
                if not len(text):
                    continue
                row, first = rows[text], first + shift[text]
                order = np.lexsort((first, digest, key, row))
                row, key, digest, first, n, a = (x[order] for x in (row, key, digest, first, n, a))
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
                head = np.flatnonzero(new)
                spots = pa.ListArray.from_arrays(np.concatenate((head, [len(row)])).astype(np.int32), pa.array(first.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(names[row[head]]), pa.array(names2[row[head]]), pa.array(key[head]), pa.array(digest[head]), pa.array(n[head].astype(np.int32)), pa.array(a[head].astype(np.int32)), spots], ["t", "t2", "key", "digest", "n", "a", "spots"])

    return run


# ---------------------------------------------------------------- the run-length index


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of texts, each in a group; suffixes are ordered by group, then content.

    heads: place in the suffix order where each run begins; first/last: text positions sampled at both ends of each run.
    """

    def __init__(self, texts: list[bytes], group: np.ndarray):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(self.bytes)
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.end = self.bounds[1:][self.text]
        self.group = np.asarray(group, dtype=np.int64)[self.text]
        suffixes = self._order(n)
        before = np.where(suffixes == self.bounds[self.text[suffixes]], -1 - self.text[suffixes], self.bytes[suffixes - 1].astype(np.int64))
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (before[1:] != before[:-1]) | (self.group[suffixes[1:]] != self.group[suffixes[:-1]])
        self.heads = np.flatnonzero(fresh)
        self.symbols = before[self.heads]
        self.first = suffixes[self.heads]
        self.last = suffixes[np.concatenate((self.heads[1:], [n])) - 1] if n else suffixes

    def _order(self, n: int) -> np.ndarray:
        """Suffix array by prefix doubling from seven bytes on; suffixes that end together stay in text order."""
        if not n:
            return np.zeros(0, np.int64)
        at = np.arange(n)
        left = self.end - at
        padded = np.concatenate((self.bytes, np.zeros(8, np.uint8)))
        key = np.zeros(n, dtype=np.uint64)
        for k in range(7):
            key = (key << np.uint64(8)) | np.where(left > k, padded[k : k + n], 0).astype(np.uint64)
        key = (key << np.uint64(8)) | np.minimum(left, 7).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(self.group[order], kind="stable")]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (self.group[order[1:]] != self.group[order[:-1]])
        depth = 7
        while True:
            rank = np.empty(n, dtype=np.int64)
            head = np.maximum.accumulate(np.where(fresh, at, 0))
            rank[order] = head
            tied = np.zeros(n, dtype=bool)  # places whose rank is shared and that have bytes beyond depth
            alone = fresh & np.concatenate((fresh[1:], [True]))
            tied = ~alone & (left[order] > depth)
            if not tied.any():
                return order
            again = np.flatnonzero(~alone)
            suffix = order[again]
            further = suffix + depth
            second = np.where(left[suffix] > depth, rank[np.minimum(further, n - 1)] + 1, 0)
            joint = head[again].astype(np.uint64) * np.uint64(n + 2) + second.astype(np.uint64)
            sub = np.argsort(joint, kind="stable")
            order[again] = suffix[sub]
            joint = joint[sub]
            fresh[again] = True
            fresh[again[1:]] = joint[1:] != joint[:-1]
            depth *= 2

    def long_matches(self, length: int) -> np.ndarray:
        """Difference array over text positions: where the string of `length` bytes that starts there also starts elsewhere in its group.

        At each run boundary the match of the two sampled suffixes is measured; from there matching lengths fall by one
        with each step in the text, so the samples cover all positions.
        """
        marks = np.zeros(len(self.bytes) + 1, dtype=np.int64)
        if len(self.heads) < 2:
            return marks
        x, y = self.last[:-1], self.first[1:]
        near = (self.group[x] == self.group[y]) & (x + length <= self.end[x]) & (y + length <= self.end[y])
        x, y = x[near], y[near]
        sums = prefix_hash(_TABLE[self.bytes])
        long = window_hash(sums, x, x + length) == window_hash(sums, y, y + length)
        x, y = x[long], y[long]
        low, high = np.full(len(x), length), np.minimum(self.end[x] - x, self.end[y] - y)
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            same = window_hash(sums, x, x + mid) == window_hash(sums, y, y + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        for z in (x, y):
            np.add.at(marks, z, 1)
            np.add.at(marks, z + low - length + 1, -1)
        return marks


def _index_groups(length: int):
    """Tables sorted by key in, marks (key, digest, start, count) out: runs of starts that repeat within their key."""

    def solve(keys: list, digests: list, texts: list[bytes]) -> pa.RecordBatch:
        group = np.unique(np.array(keys), return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        texts = [texts[k] for k in order]
        index = RunLengthIndex(texts, group[order])
        marked = np.cumsum(index.long_matches(length)[:-1]) > 0
        edge = np.zeros(len(marked) + 1, dtype=np.int8)
        edge[:-1] = marked
        edge[1:] -= marked
        cut = index.bounds[1:-1]
        both = marked[cut] & marked[cut - 1] if len(cut) else np.zeros(0, bool)  # never: a text's last starts are too short
        assert not both.any()
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = index.text[begin] if len(begin) else np.zeros(0, np.int64)
        source = order[owner]
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.int64)[source]), pa.array(np.array(digests, dtype=np.int64)[source]), pa.array((begin - index.bounds[owner]).astype(np.int32)), pa.array((end - begin).astype(np.int32))], ["key", "digest", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, digests, texts, size = [], [], [], 0
        for table in grouped(batches, ["key"]):
            digest = table.column("digest").to_pylist()
            seen = dict(zip(digest, table.column("ctx").to_pylist(), strict=True))
            if len(seen) > 1:
                keys += [table.column("key")[0].as_py()] * len(seen)
                digests += seen
                texts += seen.values()
                size += sum(map(len, seen.values()))
            if size >= INDEX_BYTES:
                yield solve(keys, digests, texts)
                keys, digests, texts, size = [], [], [], 0
        if texts:
            yield solve(keys, digests, texts)

    return run


# ---------------------------------------------------------------- dealing, and hot keys


def _cut(block: int, length: int):
    """Units into blocks of starts whose anchor distance has one quotient by `block`, keyed by the bytes that the strings of a block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pkey", "pdigest", "from", "key", "digest", "a", "n", "ctx"]
        for batch in slices(batches, 64, 1 << 18):
            out: list[list] = [[] for _ in names]
            for key, digest, a, n, ctx in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "a", "n", "ctx")), strict=True):
                raw = np.frombuffer(ctx, dtype=np.uint8)
                sums = prefix_hash(_TABLE[raw])
                lowest, highest = (a - n + 1) // block, a // block
                for t in range(lowest, highest + 1):
                    near, far = max(a - n + 1, t * block), min(a, t * block + block - 1)  # distances of the anchor from these starts
                    begin, count = a - far, far - near + 1
                    inner = (a - t * block, a - (t * block + block - 1) + length)
                    spot = [np.array([v]) for v in (max(0, inner[0]), min(len(raw), inner[1]), begin, begin + count + length - 1)]
                    shared, own = window_hash(sums, spot[0], spot[1]), window_hash(sums, spot[2], spot[3])
                    deal = mix64(shared ^ mix64(np.array([key], dtype=np.int64).view(np.uint64) + np.uint64(t * 1000 + block)))
                    for where, value in zip(out, (key, digest, begin, int(deal.view(np.int64)[0]), int(own.view(np.int64)[0]), far, count, ctx[begin : begin + count + length - 1]), strict=True):
                        where.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    return run


_MARK = "key long, digest long, start int, count int"


def _resolve(units: DataFrame, length: int, blocks: tuple[int, ...], most: int) -> DataFrame:
    """Marks of units (key, digest, a, n, ctx, d: different units of the key, at least two) that share strings with others of their key."""
    few = units.where(F.col("d") <= most).select("key", "digest", "ctx")
    marks = few.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_index_groups(length), whole=True), _MARK)
    many = units.where(F.col("d") > most).drop("d")
    if not blocks or many.isEmpty():
        return marks
    # A unit comes once, but for a text whose rows Spark dealt over several tasks.
    parts = materialize(many.dropDuplicates(["key", "digest"]).mapInArrow(lean(_cut(blocks[0], length), whole=True), "pkey long, pdigest long, from int, key long, digest long, a int, n int, ctx binary"), "blocks")
    each = parts.groupBy("key", "digest").agg(F.count("*").alias("c"))
    copies = each.where("c > 1")
    whole = parts.join(copies.hint("merge"), ["key", "digest"]).select(F.col("pkey").alias("key"), F.col("pdigest").alias("digest"), F.col("from").alias("start"), F.col("n").alias("count"))
    sizes = each.groupBy("key").agg(F.count("*").cast("int").alias("d")).where("d > 1")
    inside = parts.select("key", "digest", "a", "n", "ctx").dropDuplicates(["key", "digest"]).join(sizes.hint("merge"), "key")
    inner = _resolve(materialize(inside, "units"), length, blocks[1:], most)
    back = parts.select("pkey", "pdigest", "from", "key", "digest").join(inner.hint("merge"), ["key", "digest"]).select(F.col("pkey").alias("key"), F.col("pdigest").alias("digest"), (F.col("from") + F.col("start")).alias("start"), "count")
    return marks.unionAll(whole).unionAll(back)


def _contexts(length: int):
    """Bytes of the wanted units of each text. Copies of a text follow each other (the join before sorted them); the first one serves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        names, kinds = ["key", "digest", "a", "n", "d", "ctx"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            cols, size = [[] for _ in names], 0
            for t, t2, text, units in zip(batch.column("t").to_pylist(), batch.column("t2").to_pylist(), batch.column("text"), batch.column("units"), strict=True):
                if (t, t2) == last:
                    continue
                last, raw = (t, t2), text.as_py().encode()
                for u in units.as_py():
                    s = u["first"]
                    for where, v in zip(cols, (u["key"], u["digest"], u["a"], u["n"], u["d"], raw[s : s + u["n"] + length - 1]), strict=True):
                        where.append(v)
                    size += u["n"] + length
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
                        cols, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def repeated_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most_units: int = MOST_UNITS, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """(t, t2, ranges): for each text, named by two hashes, the runs (start, count) of string starts that repeat. texts: (t, t2, text)."""
    units = materialize(texts.mapInArrow(lean(_emit_units(length, gram)), "t long, t2 int, key long, digest long, n int, a int, spots array<int>"), "spots")
    each = units.groupBy("key", "digest").agg(F.sum(F.size("spots")).alias("c"), F.min(F.struct("t", "t2", F.element_at("spots", 1).alias("first"), "a", "n")).alias("rep"))
    each = materialize(each, "contents")
    keys = each.groupBy("key").agg(F.sum("c").alias("all"), F.count("*").cast("int").alias("d")).where("all > 1")
    wanted = each.join(keys.where("d > 1").hint("merge"), "key").select("rep.t", "rep.t2", F.struct("key", "digest", "rep.first", "rep.a", "rep.n", "d").alias("u"))
    wanted = wanted.groupBy("t", "t2").agg(F.collect_list("u").alias("units"))  # of one text: bounded by its length
    found = texts.join(wanted.hint("merge"), ["t", "t2"]).select("t", "t2", "text", "units")
    contexts = materialize(found.mapInArrow(lean(_contexts(length), whole=True), "key long, digest long, a int, n int, d int, ctx binary"), "units")
    marks = _resolve(contexts, length, blocks, most_units)
    copies = each.where("c > 1").select("key", "digest", F.lit(0).alias("start"), F.col("rep.n").alias("count"))
    marks = materialize(marks.unionAll(copies).groupBy("key", "digest").agg(F.collect_set(F.struct("start", "count")).alias("marks")), "marks")
    drop_tables(each, contexts)
    mine = units.groupBy("t", "t2", "key", "digest", F.element_at("spots", 1).alias("first")).agg(F.first("spots").alias("spots"))  # copies are one, segments are not
    ranges = mine.join(marks.hint("merge"), ["key", "digest"]).select("t", "t2", F.flatten(F.transform("spots", lambda s: F.transform("marks", lambda m: F.struct((s + m["start"]).alias("start"), m["count"].alias("count"))))).alias("ranges"))
    ranges = materialize(ranges.groupBy("t", "t2").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges")
    drop_tables(units, marks)
    return ranges


def covered(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes, as (from, to), that strings starting in the ranges cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["start"] + r["count"] - 1 + length) for r in ranges or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(text: str | None, ranges: list[dict], length: int) -> tuple[bytes, list[tuple[int, int]], int]:
    data = (text or "").encode()
    spans = covered(ranges, length)
    if not spans:
        return data, spans, len(data)
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), spans, len(data)


def _with_ranges(docs: DataFrame, text: str, options: dict) -> tuple[DataFrame, int]:
    length = options.get("length", LENGTH)
    one, two = text_hash(F.col(text))
    texts = docs.where(F.octet_length(text) >= length).select(one.alias("t"), two.alias("t2"), F.col(text).alias("text"))
    ranges = repeated_ranges(texts, **options).withColumnsRenamed({"t": "_rt", "t2": "_rt2"})
    joined = docs.withColumn("_t", one).withColumn("_t2", two).join(ranges.hint("merge"), (F.col("_t") == F.col("_rt")) & (F.col("_t2") == F.col("_rt2")), "left")
    return joined.drop("_t", "_t2", "_rt", "_rt2"), length


def analyze(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (from, to)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    joined, length = _with_ranges(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, spans, sha = [], [], [], []
            for body, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                kept, found, size = _kept(body.as_py(), ranges.as_py(), length)
                n.append(size)
                gone.append(size - len(kept))
                spans.append([{"from": a, "to": b} for a, b in found])
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from:long,to:long>>")


def remove_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Rows of docs, all columns, without their repeated bytes; a text of which nothing is left goes, others (empty ones too) stay."""
    joined, length = _with_ranges(docs, text, options)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, keep = [], []
            for body, ranges in zip(batch.column(text), batch.column("ranges"), strict=True):
                body = body.as_py()
                kept, spans, _ = _kept(body, ranges.as_py(), length)
                bodies.append(kept.decode(errors="ignore") if spans else body)
                keep.append(bool(kept) or not spans)
            columns = [pa.array(bodies, batch.schema.field(text).type) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return joined.select(*names, "ranges").mapInArrow(lean(run), docs.schema)
