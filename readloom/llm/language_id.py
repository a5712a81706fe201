"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte trigrams (letters lower-cased, other ASCII as one space). Document
frequencies are counted over all rows that may teach. Each language has several centroids, found by spherical k-means on
a bounded sample of its rows, in the task that gets this sample. A text gets the language of the centroid with the largest cosine; it is also marked as
rejected if that cosine is below what nearly all training members of the centroid reach.

Defined results: `und` and score 0 for null texts and texts without a letter, and for all texts when nothing teaches;
repeated rows are predicted alike; null ids are kept (they teach, as their remainder is not 2); null languages teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _FOLD, grouped, held_out, lean, sample_hash, sample_threshold, text_bytes

DIMENSIONS = 2048
#: Sampled rows of one language that its centroids are fitted on at most (expected), and centroids of a language.
FIT_ROWS, CENTROIDS = 800, 4
SHARPNESS, REJECT_QUANTILE, REJECT_SLACK = 12.0, 0.005, 0.8

_LETTER = re.compile(r"[^\W\d_]").search
_CLASS = _FOLD.copy()
_CLASS[:128] = np.where(np.char.isalpha(np.array([chr(c) for c in range(128)])), _FOLD[:128], 32)


def counts(column: pa.Array) -> np.ndarray:
    """Trigram counts of each text, rows by DIMENSIONS."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), dtype=np.float32)
    step = 1 << 20
    folded = _CLASS[raw]
    for k in range(n):
        for at in range(int(offsets[k]), int(offsets[k + 1]) - 2, step):
            b = folded[at : min(at + step + 2, int(offsets[k + 1]))].astype(np.uint32)
            code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
            code = code[code != 0x202020]
            out[k] += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(21), minlength=DIMENSIONS)
    return out


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    cutoffs: np.ndarray


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids from spread-out starts; returns them and each row's centroid."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    return c, (x @ c.T).argmax(axis=1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        tf = counts(batch.column("text"))
        total += (tf > 0).sum(axis=0)
        rows += len(tf)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1, dtype=np.int32)), pa.array(np.append(total, rows))], ["feature", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tf = counts(batch.column("text")).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in tf], pa.binary())], ["lang", "tf"])


def _clusters(idf: np.ndarray, centroids: int):
    """(lang, centroid, cutoff) of the sampled vectors of each language, over a partition sorted by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["lang"]):
            x = weigh(np.frombuffer(b"".join(table.column("tf").to_pylist()), dtype=np.float32).reshape(table.num_rows, DIMENSIONS), idf)
            c, own = _spherical_kmeans(x, centroids)
            reach = [(x[own == j] @ c[j]) if (own == j).any() else np.zeros(1) for j in range(len(c))]
            cutoffs = [float(np.quantile(r, REJECT_QUANTILE)) * REJECT_SLACK for r in reach]
            yield pa.RecordBatch.from_arrays([pa.array([table.column("lang")[0].as_py()] * len(c)), pa.array([v.astype(np.float32).tobytes() for v in c], pa.binary()), pa.array(cutoffs, pa.float64())], ["lang", "centroid", "cutoff"])

    return run


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model | None:
    """Learn from rows that are not held out and have a language; None if there are none.

    The driver gets one count and `centroids` vectors of DIMENSIONS numbers per language; a task gets the sample of a language."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.coalesce(F.col("text") != "", F.lit(False)))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not totals:
        return None
    df = {r["feature"]: r["n"] for r in rows.select("text").mapInArrow(lean(_frequencies), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}  # DIMENSIONS rows
    idf = (np.log((1 + df[DIMENSIONS]) / (1 + np.array([df.get(k, 0) for k in range(DIMENSIONS)]))) + 0.05).astype(np.float32)
    share = docs.sparkSession.createDataFrame([(k, sample_threshold(fit_rows, n)) for k, n in totals.items()], "lang string, threshold long")
    sample = rows.join(F.broadcast(share), "lang").where(sample_hash("lang", "doc_id", "text") < F.col("threshold"))  # one row per language
    vectors = sample.select("text", "lang").mapInArrow(lean(_vectors), "lang string, tf binary")
    found = vectors.repartition("lang").sortWithinPartitions("lang", "tf").mapInArrow(lean(_clusters(idf, centroids), whole=True), "lang string, centroid binary, cutoff double").toArrow().sort_by([("lang", "ascending"), ("centroid", "ascending")])
    if not found.num_rows:
        return None
    return Model(idf, np.array([np.frombuffer(c, dtype=np.float32) for c in found.column("centroid").to_pylist()]), found.column("lang").to_pylist(), np.array(found.column("cutoff").to_pylist()))


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score, cosine of the nearest centroid, rejected."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = sorted(set(model.languages)) if model else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                letters = np.array([bool(t) and _LETTER(t) is not None for t in batch.column("text").to_pylist()], dtype=bool)
                lang, score, cosine, rejected = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
                if model and letters.any():
                    near = weigh(counts(batch.column("text")), model.idf) @ model.centroids.T
                    best = np.stack([near[:, [k for k, o in enumerate(model.languages) if o == name]].max(axis=1) for name in names], axis=1)
                    top, which = best.argmax(axis=1), near.argmax(axis=1)
                    soft = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
                    lang = np.where(letters, np.array(names, dtype=object)[top], "und")
                    score = np.where(letters, 1 / soft.sum(axis=1), 0.0)
                    cosine = np.where(letters, near.max(axis=1), 0.0)
                    rejected = ~letters | (cosine < model.cutoffs[which])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score.astype(float)), pa.array(cosine.astype(float)), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cosine", "rejected"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double, cosine double, rejected boolean")
