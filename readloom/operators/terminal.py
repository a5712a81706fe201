"""Terminal sites: position histograms, moments, peaks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PAD, PEAK_DISTANCE, REL_HEIGHT = 10, 10, 0.98


def histogram(positions: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    return positions.groupBy(*by, pos).agg(F.count("*").alias("n"))


def dense_histogram(hist: DataFrame, by: list[str], pos: str = "pos", pad: int = PAD) -> DataFrame:
    """Zero-filled histogram from `pad` before the first position to `pad` behind the last, as (start, counts)."""
    rows = hist.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(pos, "n"))).alias("_m"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    places = F.sequence(F.col("_lo") - pad, F.col("_hi") + pad)
    return rows.select(*by, (F.col("_lo") - pad).alias("start"), F.transform(places, lambda p: F.coalesce(F.try_element_at("_m", p), F.lit(0).cast("bigint"))).alias("counts"))


def moments(hist: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Population variance, biased skewness (null for up to 3 values or no spread), entropy of the histogram, mode (smallest), mean height."""
    x, n = F.col(pos).cast("double"), F.col("n").cast("double")
    mean = F.sum(x * n).over(W.partitionBy(*by)) / F.sum(n).over(W.partitionBy(*by))
    rows = hist.withColumn("_d", x - mean).withColumn("_t", F.sum(n).over(W.partitionBy(*by)))
    out = rows.groupBy(*by).agg(
        F.sum(n).alias("total"), (F.sum(n * F.col("_d") ** 2) / F.sum(n)).alias("var"), (F.sum(n * F.col("_d") ** 3) / F.sum(n)).alias("_m3"),
        (-F.sum(n / F.col("_t") * F.log(n / F.col("_t")))).alias("entropy"), F.min_by(pos, F.struct(-F.col("n"), F.col(pos))).alias("mode"),
        (F.sum(n) / (F.max(pos) - F.min(pos) + 1 + 2 * PAD)).alias("mean_height"),
    )
    return out.withColumn("skew", F.when((F.col("total") > 3) & (F.col("var") > 1e-12), F.col("_m3") / F.pow("var", F.lit(1.5)))).drop("_m3")


def find_peaks(h: np.ndarray, distance: int = PEAK_DISTANCE) -> np.ndarray:
    """Local maxima (middles of plateaus); of two closer than distance the lower goes, the later of equals stays."""
    n = len(h)
    edges = np.flatnonzero(np.diff(h)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [n])) - 1
    inner = (starts > 0) & (ends < n - 1)
    up = inner & (h[np.maximum(starts - 1, 0)] < h[starts]) & (h[np.minimum(ends + 1, n - 1)] < h[ends])
    peaks = (starts[up] + ends[up]) // 2
    keep = np.ones(len(peaks), dtype=bool)
    for k in np.argsort(h[peaks], kind="stable")[::-1]:
        if keep[k]:
            close = (np.abs(peaks - peaks[k]) < distance) & (np.arange(len(peaks)) != k)
            keep[close] = False
    return peaks[keep]


def peak_widths(h: np.ndarray, peaks: np.ndarray, rel_height: float = REL_HEIGHT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Width, left and right crossing at height - rel_height * prominence, interpolated."""
    widths, lefts, rights = [], [], []
    for p in peaks:
        higher = np.flatnonzero(h > h[p])
        lo = higher[higher < p].max() + 1 if (higher < p).any() else 0
        hi = higher[higher > p].min() - 1 if (higher > p).any() else len(h) - 1
        prominence = h[p] - max(h[lo : p + 1].min(), h[p : hi + 1].min())
        # the bases: nearest minima on each side
        level = h[p] - rel_height * prominence
        i = p
        while i > lo and level < h[i]:
            i -= 1
        left = i + ((level - h[i]) / (h[i + 1] - h[i]) if h[i] < level and i < p else 0.0)
        j = p
        while j < hi and level < h[j]:
            j += 1
        right = j - ((level - h[j]) / (h[j - 1] - h[j]) if h[j] < level and j > p else 0.0)
        widths.append(right - left)
        lefts.append(left)
        rights.append(right)
    return np.array(widths), np.array(lefts), np.array(rights)


def default_scorer(features: pd.DataFrame) -> np.ndarray:
    """Accepts peaks of at least a tenth of the highest; stands in where no trained model is given."""
    return (features["relative_height"] >= 0.1).to_numpy()


PEAK_SCHEMA = "position bigint, reads bigint, left bigint, right bigint, height bigint, relative_height double"


def detect(hist: DataFrame, by: list[str], pos: str = "pos", scorer: Callable[[pd.DataFrame], np.ndarray] = default_scorer) -> DataFrame:
    """Accepted peaks of each group's histogram; a histogram without a peak gives its mode. scorer: features of peaks to True/False."""
    kinds = ", ".join(f"`{c}` {hist.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        start = int(pdf[pos].iloc[0])
        h = np.zeros(int(pdf[pos].iloc[-1]) - start + 1 + 2 * PAD, dtype=np.int64)
        h[pdf[pos].to_numpy() - start + PAD] = pdf["n"].to_numpy()
        key = [pdf[c].iloc[0] for c in by]
        peaks = find_peaks(h)
        if not len(peaks):
            mode = int(h.argmax())
            rows = [(*key, mode - PAD + start, int(h[mode]), mode - PAD + start, mode - PAD + start, int(h[mode]), 1.0)]
        else:
            width, left, right = peak_widths(h, peaks)
            x = np.repeat(np.arange(len(h)), h)
            var = x.var()
            features = pd.DataFrame({"var": var, "skew": ((x - x.mean()) ** 3).mean() / var**1.5 if len(x) > 3 and var > 1e-12 else np.nan, "peak_count": len(peaks), "peak_width": width, "entropy": -sum(v / h.sum() * np.log(v / h.sum()) for v in h if v), "mean_height": h.mean(), "peak_heights": h[peaks], "relative_height": h[peaks] / h[peaks].max()})
            rows = [
                (*key, int(p) - PAD + start, int(h[max(0, int(a)) : int(b) + 1].sum()), int(a) - PAD + start, int(b) - PAD + start, int(h[p]), float(r))
                for p, a, b, r, ok in sorted(zip(peaks, left, right, features["relative_height"], scorer(features), strict=True), key=lambda v: (-v[3], v[0])) if ok
            ]
        return pd.DataFrame(rows, columns=[*by, "position", "reads", "left", "right", "height", "relative_height"])

    return hist.groupBy(*by).applyInPandas(run, f"{kinds}, {PEAK_SCHEMA}")


def known_or_novel(peaks: DataFrame, sites: DataFrame, by: list[str], within: int = 10) -> DataFrame:
    """Flag Known for peaks within `within` of an annotated site of the group, else Novel."""
    near = sites.groupBy(*by).agg(F.collect_set("site").alias("_sites"))
    flag = F.exists(F.coalesce("_sites", F.array().cast("array<bigint>")), lambda s: F.abs(s - F.col("position")) <= within)
    return peaks.join(near, by, "left").withColumn("flag", F.when(flag, "Known").otherwise("Novel")).drop("_sites")
