"""Results that several plans read: written once to the folder that the cluster shares, with their lineage cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder of checkpoints, set if it is not: ``spark.checkpoint.dir``, or on a local master only a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="larkspur-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder that the driver and all executors share."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in ``spark.checkpoint.dir`` or the context's folder.

    Without either a temporary folder stands in on a local master only; any other master raises.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)
