"""Streaming forms of two operators: regions as sessions of positions in time, and molecules seen once within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of a key without a longer gap: the counterpart of regions of overlapping alignments."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_molecules(reads: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first read of each molecule (exact UMIs) within the watermark; state is bounded by it."""
    return reads.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
