"""Packing by power-of-two decomposition.

A document of n tokens (its ids, then an end id) becomes n // most pieces of `most` tokens and one piece for each set bit
of the rest, longest first. Every piece is a sequence of its own and of a power-of-two length, so no sequence crosses
documents and none is padded; sequences of one length form a bucket, from which batches of equal shape are drawn.
Nothing is shuffled: a piece depends on its document alone.

Defined results: null and empty texts give the end id alone; repeated rows are packed each; null ids are kept; extra
columns are ignored; an empty table gives no pieces. Ids are those of the tokenizer over the whole text: it is run on
words of its pre-tokenizer's pattern (plain Latin texts) or on white-space separated chunks, which it never joins, and
each worker keeps the ids of words seen (bounded); texts with the control characters that Python and the tokenizer split
differently are encoded whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID, MOST = 2, 4096
_KEPT: dict[str, ChunkEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memory(dict):
    """Ids by key, made on a miss; of the entries, those of the last `most` misses or finds in the older half stay.

    When the younger half is full it becomes the older one, so frequent keys are never made again."""

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
            if len(key) > self.longest:
                return ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = ids
        return ids


class ChunkEncoder:
    """Token ids of texts as little-endian uint32 bytes, with bounded memories of chunks and words."""

    def __init__(self, path: str, remember: int = 250_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words = _Memory(self._word, remember)
        self.chunks = _Memory(self._chunk, remember // 8)
        kinds = {chr(c): unicodedata.category(chr(c))[0] for c in range(0x250)}
        letters = re.escape("".join(c for c, k in kinds.items() if k == "L"))
        numbers = re.escape("".join(c for c, k in kinds.items() if k == "N"))
        # The pre-tokenizer's pattern, for plain Latin characters (U+0130 lower-cases to two); no match crosses white space.
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+").findall
        self.plain = re.compile("[\t-\r !-;=-~¡-įı-ɏ]*").fullmatch
        self.odd = re.compile("[\x1c-\x1f]").search
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def _word(self, word: str) -> bytes:
        symbols = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_chars)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self.plain(chunk):
            return b"".join(map(self.words.__getitem__, self.split(chunk.lower())))
        return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> bytes:
        if self.plain(text):
            return b"".join(map(self.words.__getitem__, self.split(text.lower())))
        if self.odd(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.chunks.__getitem__, text.split()))


def encoder(path: str) -> ChunkEncoder:
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = ChunkEncoder(path)
    return _KEPT[path]


def piece_lengths(n: int, most: int = MOST) -> list[int]:
    """Lengths of the pieces of n tokens: full ones, then one for each set bit of the rest, longest first. `most` is a power of two."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, most: int = MOST) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket (log2 of length), sequence_id, offset, ids (little-endian uint32)."""
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    end = array("I", [end_id]).tobytes()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or default_tokenizer()).text
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                owner, start, length, tokens, ids = [], [], [], [], []
                for k, body in enumerate(batch.column("text").to_pylist()):
                    data = encode(body or "") + end
                    n, done = len(data) // 4, 0
                    for size in piece_lengths(n, most):
                        owner.append(k)
                        start.append(done)
                        length.append(size)
                        tokens.append(n)
                        ids.append(data[4 * done : 4 * (done + size)])
                        done += size
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.int64()), pa.array([x.bit_length() - 1 for x in length], pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "bucket", "ids"])

    pieces = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, bucket int, ids binary")
    # Numbered by partition and place: unique without a shuffle; the splits of the input, and so a rerun task, are fixed in the plan.
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences by bucket: one folder for each length, for loaders that draw batches of equal shape."""
    pieces.select("sequence_id", "doc_id", "ids", "bucket").write.partitionBy("bucket").parquet(path)
