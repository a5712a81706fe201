"""Embedding near-dedup: int8 tile products with rigorous error bounds, full precision only where the bound leaves it open.

Equal vectors of a label collapse first (a partial aggregate). The distinct vectors of each label are dealt into tiles by
a hash; each pair of tiles of a label is one product. A unit vector x is quantised as q * s with |x - q * s| = e, measured
per vector, so for unit x and y: |x.y - s_x s_y (q_x.q_y)| <= e_x * |y| + e_y * s_x * |q_x|. Only pairs whose upper bound
reaches the threshold are computed again, as cosines in double precision. A task gives link counts and a spanning forest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label,
link with nothing and are kept; vectors of different dimensions link with nothing; repeated rows are copies and count as
links; a component id is the smallest id of the component (null only if all its ids are null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, grouped, lean, materialize
from .components import connected_components
from .jaccard_join import _block_pairs, _local_components


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and measured errors |x - code * scale| of the rows; the error is rounded up."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return codes, scale, error


def upper_bounds(codes: np.ndarray, scale: np.ndarray, error: np.ndarray, a: slice, b: slice) -> np.ndarray:
    """Upper bounds of the cosines of rows a and rows b. Sums of int8 products stay exact in single precision up to 1,000 dimensions; longer ones use double."""
    kind = np.float32 if codes.shape[1] <= 1000 else np.float64
    product = (codes[a].astype(kind) @ codes[b].astype(kind).T).astype(np.float64)
    product *= scale[a][:, None] * scale[b][None, :]
    size = scale[a] * np.sqrt((codes[a].astype(np.float64) ** 2).sum(axis=1))
    return product + error[a][:, None] * (1 + 1e-9) + error[b][None, :] * size[:, None] + 1e-9


def _tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["label", "dims", "i", "j"]):
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            order = np.argsort(np.asarray(table.column("mine")), kind="stable")
            table = table.take(pa.array(order))
            mine, node, weight = (np.asarray(table.column(c)) for c in ("mine", "node", "weight"))
            vectors = np.array(table.column("embedding").to_pylist(), dtype=np.float64)
            unit = vectors / np.abs(vectors).max(axis=1)[:, None]
            unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
            codes, scale, error = quantise(unit)
            n = len(node)
            cut = int((mine == i).sum())
            a, b = (slice(0, n), slice(0, n)) if i == j else (slice(0, cut), slice(cut, n))
            x, y = np.nonzero(upper_bounds(codes, scale, error, a, b) >= threshold)
            y = y + b.start
            if i == j:
                x, y = x[x < y], y[x < y]
            linked = np.empty(len(x), dtype=bool)
            for at in range(0, len(x), 1 << 16):
                p, q = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                linked[at : at + (1 << 16)] = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
            x, y = x[linked], y[linked]
            links = np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)
            root = node[_local_components(n, x, y)]
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(root[some]), pa.array(np.rint(links[some]).astype(np.int64))], ["node", "root", "links"])

    return run


def _identity(label: Column, embedding: Column) -> list[Column]:
    """(h1, h2): 128 bits that tell vectors of a label apart; null for those that link with nothing."""
    good = ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(embedding, lambda x: x != 0)
    plain = F.transform(embedding, lambda x: x + F.lit(0.0))  # one zero
    usable = label.isNotNull() & F.coalesce(good, F.lit(False))
    return [F.when(usable, F.xxhash64(label, plain)).alias("h1"), F.when(usable, F.xxhash64(F.lit("second"), plain, label)).alias("h2")]


def _near_duplicates(vectors: DataFrame, vec_id: str, embedding: str, label: str, threshold: float = 0.98, tile: int = 1024) -> DataFrame:
    """near_duplicates() with h1 and h2."""
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label"))
    v = v.select("vec_id", "embedding", "label", *_identity(F.col("label"), F.col("embedding")))
    # Classes of equal vectors; in the written table each has a number of its own.
    nodes = v.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    nodes = materialize(nodes.withColumn("dims", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = nodes.groupBy("label", "dims").agg(F.count("*").alias("size"))
    dealt = _block_pairs(nodes.select("node", "weight", "embedding", "label", "dims").join(sizes.hint("merge"), ["label", "dims"]), "size", tile, "node").select("label", "dims", "i", "j", F.col("_mine").alias("mine"), "node", "weight", "embedding")
    links = dealt.repartition("label", "dims", "i", "j").sortWithinPartitions("label", "dims", "i", "j").mapInArrow(lean(_tiles(threshold), whole=True), "node long, root long, links long")
    links = materialize(links, "vector-links")
    found = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), label="vectors")
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.select("node", "h1", "h2", "first_id", "weight").join(total.hint("merge"), "node", "left").join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = info.groupBy("component").agg(F.min("first_id").alias("component_id"))
    info = materialize(info.join(firsts.hint("merge"), "component").select("node", "h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links")), "linked")
    drop_tables(nodes, links)
    out = v.select("vec_id", "h1", "h2").join(info.hint("merge"), ["h1", "h2"], "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), "h1", "h2")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **options) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept. Options: threshold, tile (vectors compared in one task, by pairs of tiles)."""
    return _near_duplicates(vectors, vec_id, embedding, label, **options).drop("h1", "h2")


def keep_one(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **options) -> DataFrame:
    """Rows of vectors, all columns, whose id is the smallest of its component (or null). A row goes by its id and vector: another
    vector under the same id stays or goes for itself."""
    gone = _near_duplicates(vectors, vec_id, embedding, label, **options).where("not kept").select(F.col("vec_id").alias("_gone"), F.col("h1").alias("_g1"), F.col("h2").alias("_g2")).distinct()
    one, two = _identity(F.col(label), F.col(embedding).cast("array<double>"))
    same = (F.col(vec_id) == F.col("_gone")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))
    return vectors.withColumn("_h1", one).withColumn("_h2", two).join(gone, same, "left_anti").drop("_h1", "_h2")
