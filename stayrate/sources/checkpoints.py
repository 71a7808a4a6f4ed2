"""Cutting lineage in storage that outlives executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local folder only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="stayrate-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the checkpoint folder.

    For frames that several later steps read and that must not change between them:
    rows placed by range partitioning, whose sampled bounds differ from run to run.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a working table beside the checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
