"""Lineage cuts and scratch space that survive the loss of an executor."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests, a laptop) is a
    local folder made, once; a cluster without a shared folder is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="cpgspark-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; every call gives another one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write once as Parquet under the shared folder and read back.

    Used where several jobs consume the same expensive frame: the files keep
    column statistics and pruning, which a checkpoint does not.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
