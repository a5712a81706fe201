"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. run() writes each result as Parquet in the shared folder and reads it for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from readloom.llm.common import drop_tables, materialize, read_table, short_batches
from readloom.llm.queries import digest_pieces


#: Repeated passages of more than 50 words are to go: 51 words of ordinary prose have 250 bytes or more in 99 of 100 places.
PASSAGE_BYTES = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go; it learns from the labels of documents that are not held out."""
    return toxicity.remove_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return jaccard_join.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of PASSAGE_BYTES or more that occur twice go; a document that is nothing but such passages goes whole."""
    return with_length(suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of benchmark windows go; a document stays, even if no word is left of it."""
    return with_length(decontaminate.remove_spans(docs, read_table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths."""
    return digest_pieces(packing.pack(docs))


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _short(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with fewer rows at a time in the Python workers."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _short(drop_toxic)),
    ("ngram_jaccard_join", _short(drop_near_duplicates)),
    ("suffix_array_dedup", _short(drop_repeats)),
    ("decontamination", _short(drop_benchmark)),
    ("packing", _short(pack)),
]

#: SQL can express neither the tokenizer nor the learned grammar.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if done is not None:
            drop_tables(done)  # its successor is written
        done = docs
    return docs
