"""Cutting lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that spark.checkpoint.dir names. Where it is unset, a local session (tests) gets a folder of its
    own, and a cluster is refused, as its machines share no local folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not at:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="readloom-")
        context.setCheckpointDir(at)
    return df.checkpoint()
