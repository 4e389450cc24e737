"""Session defaults for this package."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime re-planning does the sizing of reducers, of broadcast sides and of
# skewed join partitions, so nothing here depends on the size of the data.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app_name: str = "cpgspark", master: str | None = None, **extra: str) -> SparkSession:
    """Build (or fetch) a session.  On a cluster leave ``master`` unset and size
    ``spark.sql.shuffle.partitions`` to a few times the executor cores."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
