"""python -m readloom --gtf FILE --sam FILE... --out FOLDER: the bulk run on a Spark session of the environment."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.counting import STRATEGIES
from .params import DISCOVERY, MATCHING
from .plans.transcripts import run


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="readloom")
    p.add_argument("--gtf", required=True)
    p.add_argument("--sam", nargs="+", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--matching", choices=MATCHING, default="default")
    p.add_argument("--models", choices=DISCOVERY, default="default_ont")
    p.add_argument("--gene-strategy", choices=STRATEGIES, default="unique_splicing_consistent")
    p.add_argument("--transcript-strategy", choices=STRATEGIES, default="unique_only")
    p.add_argument("--min-mapq", type=int, default=0)
    p.add_argument("--secondary", action="store_true")
    p.add_argument("--by-file", action="store_true", help="count by input file")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("readloom").getOrCreate()
    run(spark, a.gtf, a.sam, a.out, preset=a.matching, models=a.models, gene_strategy=a.gene_strategy, transcript_strategy=a.transcript_strategy, least_mapq=a.min_mapq, secondary=a.secondary, group="file_group" if a.by_file else None)


if __name__ == "__main__":
    main()
