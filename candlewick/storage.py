"""Storing small intermediate tables that several plans read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the cluster's shared folder, so that what follows
    reads the stored rows instead of the facts and survives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            # Driver and executors are one process, so its own disk is shared.
            folder = tempfile.mkdtemp(prefix="candlewick-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
