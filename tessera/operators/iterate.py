"""Lineage cuts for iterative plans."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read again from the folder in spark.checkpoint.dir: later steps neither plan nor compute the earlier ones again, and lost executors cost nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), f"checkpoints-{context.applicationId}")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """The rows of a table that must be small, as a local table that joins may send to every task; more than `most` rows are an error, which names them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return df.sparkSession.createDataFrame(rows, df.schema)
