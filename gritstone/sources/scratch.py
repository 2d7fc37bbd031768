"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/gritstone-{name}-{uuid.uuid4().hex}"


def checkpointed(table: DataFrame) -> DataFrame:
    """The table, computed and kept in the shared folder."""
    shared_folder(table.sparkSession)
    return table.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, in local mode one of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get(CHECKPOINT_KEY, None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="gritstone-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
