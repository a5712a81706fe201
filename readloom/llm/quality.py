"""Document quality by hierarchical empirical Bayes.

A logistic classifier on byte-level features, fitted on a bounded sample of labelled rows, gives each document's own
evidence. Grouped aggregation gives label counts of each path, host and the whole corpus. Rates are shrunk level by level
(path toward host, host toward the corpus); how strongly is estimated from the spread between hosts (between paths) by
the method of moments. The score joins both: the classifier's log odds plus those of the path against the corpus.

Defined results: null and empty texts have zero features; repeated rows score alike; null hosts and paths form groups of
their own; null labels and ids teach nothing; without labels every prior is one half and the classifier is silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, lean, materialize, sample_hash, sample_threshold, text_bytes, word_hashes

#: Labelled rows that the classifier is fitted on at most (expected).
FIT_ROWS = 20_000
#: Sites (pairs of host and path) whose rates are broadcast at most; the rates of more are joined by a shuffle.
BROADCAST_SITES = 100_000
_KINDS = ("upper", "lower", "digit", "space", "newline", "stop", "symbol", "wide")
_KIND = np.full(256, 6, dtype=np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[32], _KIND[10], _KIND[128:] = 0, 1, 2, 3, 4, 7
_KIND[[33, 44, 46, 58, 59, 63]] = 5
FEATURES = [*_KINDS, "bang", "pipe", "repeated", "word_length", "log_words"]


def features(column: pa.Array) -> np.ndarray:
    """Shares of byte kinds, of '!' and '|', of words equal to the word before, mean word length and log of words."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    row = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    out[:, :8] = np.bincount(row * 8 + _KIND[raw], minlength=8 * n).reshape(n, 8) / size[:, None]
    out[:, 8] = np.bincount(row[raw == 33], minlength=n) / size
    out[:, 9] = np.bincount(row[raw == 124], minlength=n) / size
    words, bounds = word_hashes(raw, offsets)
    total = np.maximum(np.diff(bounds), 1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    again = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
    out[:, 10] = np.bincount(owner[again], minlength=n) / total
    out[:, 11] = (out[:, 0] + out[:, 1] + out[:, 2] + out[:, 7]) * size / total / 10
    out[:, 12] = np.log1p(np.diff(bounds)) / 10
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Model:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])


def usable_labels(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(doc_id, y): one label for each id that is not held out."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Model | None:
    usable = usable_labels(labels, doc_id, label)
    total = usable.count()
    if not total:
        return None
    chosen = usable.where(sample_hash("quality", "doc_id") < sample_threshold(fit_rows, total))
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by fit_rows
    table = sample.select("y", "text").mapInArrow(lean(_featurize), "y int, x binary").toArrow()
    if not table.num_rows:
        return None
    x = np.array([np.frombuffer(b) for b in table.column("x").to_pylist()])
    return _logistic(x, np.asarray(table.column("y"), dtype=float))


def _strength(groups: DataFrame, good: str, n: str, rate: str) -> float:
    """Prior strength by moments: p(1-p)/v - 1 for the spread v of group rates beyond sampling noise; one value from one aggregate."""
    p = F.col(rate)
    noise = p * (1 - p) / F.col(n)
    row = groups.where(F.col(n) > 0).agg(F.sum(F.col(n) * ((F.col(good) / F.col(n) - p) ** 2 - noise)).alias("v"), F.sum(F.col(n) * p * (1 - p)).alias("pq"), F.sum(n).alias("n")).head()
    if not row["n"] or not row["pq"] or row["v"] is None or row["v"] <= 0:
        return 1000.0
    return float(min(1000.0, max(1.0, row["pq"] / row["v"] - 1)))


def score(docs: DataFrame, labels: DataFrame, model: Model | None, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Per row of docs: doc_id, score, evidence (own log odds), host_rate, path_rate. host and path are columns of docs."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = model.logit(features(batch.column("text"))) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array(logit, pa.float64())], ["doc_id", "host", "path", "evidence"])

    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("\x00")).alias("host"), F.coalesce(path.cast("string"), F.lit("\x00")).alias("path"), F.col(text).alias("text"))
    rows = materialize(named.mapInArrow(lean(run), f"doc_id {kind}, host string, path string, evidence double"), "quality")
    taught = rows.select("doc_id", "host", "path").join(usable_labels(labels, doc_id, label).hint("merge"), "doc_id")
    paths = taught.groupBy("host", "path").agg(F.sum("y").alias("good"), F.count("*").alias("n"))
    paths = materialize(rows.select("host", "path").distinct().join(paths.hint("merge"), ["host", "path"], "left").fillna(0, ["good", "n"]), "paths")
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).head()
    base = ((whole["good"] or 0) + 1) / ((whole["n"] or 0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n")).withColumn("base", F.lit(base))
    k = _strength(hosts, "host_good", "host_n", "base")
    hosts = hosts.select("host", ((F.col("host_good") + k * base) / (F.col("host_n") + k)).alias("host_rate"))
    paths = paths.join(hosts.hint("merge"), "host")
    m = _strength(paths, "good", "n", "host_rate")
    paths = paths.select("host", "path", "host_rate", ((F.col("good") + m * F.col("host_rate")) / (F.col("n") + m)).alias("path_rate"))
    odds = lambda c: F.log(c / (1 - c))
    few = paths.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    found = rows.join(F.broadcast(paths) if few else paths.hint("merge"), ["host", "path"])
    return found.select("doc_id", (1 / (1 + F.exp(-(F.col("evidence") + odds(F.col("path_rate")) - odds(F.lit(base)))))).alias("score"), "evidence", "host_rate", "path_rate")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    """The first folder of the path."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
