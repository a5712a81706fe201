"""Helpers shared by the training-data operators: shared storage, byte-level word hashing, grouped streams."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of normalised text: digits, lower-case ASCII letters and anything outside ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: spark.checkpoint.dir, or the context's checkpoint folder. Where neither is
    set, a local session (tests) gets a folder of its own, and a cluster is refused, as its machines share no local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and spark.sparkContext.getCheckpointDir():
        at = spark.sparkContext.getCheckpointDir().rstrip("/").rpartition("/")[0]  # Spark adds a folder of its own
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/readloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; later reads survive the loss of any executor."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*dfs: DataFrame) -> None:
    """Remove tables made by materialize() that nothing reads any more."""
    for df in dfs:
        jvm = df.sparkSession._jvm
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts may be long: fewer rows than Spark's default go to a Python worker at a time, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most so many rows, and bytes (but for single rows), so that few texts are unpacked at a time."""
    for whole in batches:
        todo = [whole.slice(at, rows) for at in range(0, whole.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], whole: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function over slices() (with whole, over the batches as they come); what it freed goes back to the system at its end."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches if whole else slices(batches))
        _release()

    return runs


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Hashes of sampled rows lie below a threshold out of this many.
SAMPLE_SPACE = 1 << 62


def sample_threshold(most: int, total: int) -> int:
    """Threshold for sample_hash() that `most` of `total` rows lie below, as expected; exact at every size, and never zero."""
    return SAMPLE_SPACE if total <= most else max(1, SAMPLE_SPACE * most // total)


def sample_hash(salt: str, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(SAMPLE_SPACE))


def text_hash(text: Column) -> list[Column]:
    """(_t, _t2): 96 bits that tell texts apart; null has a hash, too."""
    return [F.xxhash64(text).alias("_t"), F.hash(text).alias("_t2")]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- hashing over whole batches of bytes

_TABLE = np.random.default_rng(20240607).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    key = str(base)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = _POWERS[key] = np.multiply.accumulate(out)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (64-bit variant with two multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and len+1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of values[j] * base**j over j < i; window hashes are (S[e]-S[s]) * base**-s."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=out[1:])
    return out


def window_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * _powers(_INVERSE, len(sums))[start])


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, and where the words of each text begin (len(texts)+1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = _IS_WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[(offsets < n)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins[:n])
    stops = ~inside.copy()
    stops[cut] = True
    stops[n] = True
    at = np.flatnonzero(stops)
    ends = at[np.searchsorted(at, starts, side="right")]
    hashes = window_hash(prefix_hash(_TABLE[_FOLD[raw]]), starts, ends)
    return hashes, np.searchsorted(starts, offsets, side="left")


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words in each text; a text of fewer words, but not none, has one run of all of them."""
    counts = np.diff(bounds)
    long = np.maximum(counts - width + 1, 0)
    each = np.where(long > 0, long, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(each)))
    starts = np.repeat(bounds[:-1], each) + np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], each)
    ends = np.minimum(starts + width, np.repeat(bounds[1:], each))
    return window_hash(prefix_hash(words), starts, ends), out_bounds


# ---------------------------------------------------------------- groups of sorted partitions


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys, one at a time, from batches sorted by them (repartition by keys, then sortWithinPartitions)."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            col = batch.column(k)
            if batch.num_rows > 1:
                change[1:] |= ~np.asarray(pa.compute.fill_null(pa.compute.equal(col[1:], col[:-1]), False).to_numpy(zero_copy_only=False), dtype=bool)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if key != last and held:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)
