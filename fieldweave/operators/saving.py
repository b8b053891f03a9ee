"""Cut lineage through the cluster's checkpoint folder, so that loops keep short plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode, where driver and executors are one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="fieldweave-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that all executors share."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{_checkpoint_folder(spark).rstrip('/')}/fieldweave-{name}-{uuid.uuid4().hex}"
