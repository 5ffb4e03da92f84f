"""Cutting long lineages in storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder that spark.checkpoint.dir names. A local session without it takes a folder of its own; a cluster must name one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        there = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not there and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(there or tempfile.mkdtemp(prefix="selfsim-"))
    return df.checkpoint()
