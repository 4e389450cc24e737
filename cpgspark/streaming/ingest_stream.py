"""Incremental loading: new report files become samples, each row exactly once.

The file source remembers which files it has read.  The unit is the report: a file, or a
folder of part files.  The first report of a sample is its own; parts of it that arrive
later are added, other reports of the sample are ignored.  The parsed rows are kept, and
each micro-batch works out anew the samples it touches, so a mean never rests on a part of
the rows.  Samples without an id wait among the parsed rows until they have one.

A batch owns the folder of its number in every part of the table and overwrites only that:
run again after a failure it replaces its own files.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cpgspark.functions.identifiers import REPORT_SUFFIX
from cpgspark.operators.harmonise import harmonise_v2
from cpgspark.plans.durable import store
from cpgspark.plans.sizing import small_side
from cpgspark.sources.tables import parse_reports, report_lines

TABLE_SCHEMA = "sample_id string, meth_sample_id string, probe_id string, value double"
SAMPLES_SCHEMA = "meth_sample_id string"
REPORTS_SCHEMA = "meth_sample_id string, report string"
RAW_SCHEMA = (
    "meth_sample_id string, version string, Name string, EPICv1_Loci string, MValue double"
)


def _part(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One part of the target table; made empty if it does not exist yet."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch_id=-1")
    return spark.read.schema(schema + ", batch_id long").parquet(path)


def _own(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _report_of(suffix: str):
    """The report a file belongs to: its folder of parts, or itself."""
    folder = F.regexp_extract("file", "^(.*" + suffix.replace(".", "[.]") + ")/", 1)
    return F.when(folder != "", folder).otherwise(F.col("file"))


def append_new(batch: DataFrame, batch_id: int, target: str) -> None:
    """Set the rows of all samples in the batch; earlier rows of theirs no longer count."""
    spark = batch.sparkSession
    for name, schema in (("rows", TABLE_SCHEMA), ("samples", SAMPLES_SCHEMA)):
        _part(spark, f"{target}/{name}", schema)
    _own(
        batch.select("sample_id", "meth_sample_id", "probe_id", "value"), f"{target}/rows", batch_id
    )
    added = spark.read.schema(TABLE_SCHEMA).parquet(f"{target}/rows/batch_id={batch_id}")
    _own(added.select("meth_sample_id").distinct(), f"{target}/samples", batch_id)


def keep_reports(batch: DataFrame, batch_id: int, target: str, suffix: str) -> DataFrame:
    """Store the parsed rows of the batch's own reports; returns their samples."""
    spark = batch.sparkSession
    parsed = parse_reports(batch).withColumn("report", _report_of(suffix))
    parsed = store(parsed, "parsed")
    earlier = _part(spark, f"{target}/reports", REPORTS_SCHEMA).filter(
        F.col("batch_id") != batch_id
    )
    claims = parsed.select("meth_sample_id", "report", F.lit(1).alias("turn")).distinct()
    claims = store(claims, "claims")
    # The earliest claim wins; within a batch the first by name.
    owner = (
        earlier.select("meth_sample_id", "report", F.lit(0).alias("turn"))
        .unionByName(claims)
        .groupBy("meth_sample_id")
        .agg(F.min_by("report", F.struct("turn", "report")).alias("report"))
    )
    _part(spark, f"{target}/raw", RAW_SCHEMA)
    # A line for each report: the rows themselves are written once, not again for their claims.
    mine = store(claims.join(owner, ["meth_sample_id", "report"], "left_semi").drop("turn"), "claimed")
    _own(mine, f"{target}/reports", batch_id)
    _own(
        parsed.join(small_side(mine), ["meth_sample_id", "report"], "left_semi").select(
            "meth_sample_id", "version", "Name", "EPICv1_Loci", "MValue"
        ),
        f"{target}/raw",
        batch_id,
    )
    return mine.select("meth_sample_id").distinct()


def run_available(
    stream: DataFrame,
    load: Callable[[DataFrame, int], None],
    checkpoint: str,
) -> StreamingQuery:
    """Give every file that is there to ``load(batch, batch_id)``, then stop."""
    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_reports(
    spark: SparkSession,
    root: str,
    target: str,
    checkpoint: str,
    mapping: DataFrame,
    features: DataFrame,
    samples: DataFrame,
    folders: bool = False,
    suffix: str = REPORT_SUFFIX,
) -> None:
    """New reports to measurements: sample id, harmonised loci, model features.

    ``samples`` gives ``sample_id`` for each ``meth_sample_id``.
    """

    @functools.cache
    def lists() -> tuple[DataFrame, DataFrame, DataFrame]:
        """The same for every batch: worked out once, by the first."""
        return (
            store(mapping, "probe-map"),
            store(features.select("probe_id").distinct(), "features"),
            store(samples.select("sample_id", "meth_sample_id").distinct(), "named"),
        )

    def work_out(touched: DataFrame, batch_id: int) -> None:
        mapping, features, named = lists()
        raw = _part(spark, f"{target}/raw", RAW_SCHEMA).join(touched, "meth_sample_id", "left_semi")
        second = harmonise_v2(raw.filter("version = 'v2'"), mapping, ["MValue"]).select(
            "meth_sample_id", F.col("probeName").alias("probe_id"), "value"
        )
        first = raw.filter("version = 'v1'").select(
            "meth_sample_id", F.col("Name").alias("probe_id"), F.col("MValue").alias("value")
        )
        wanted = second.unionByName(first).join(small_side(features), "probe_id", "left_semi")
        append_new(wanted.join(named, "meth_sample_id"), batch_id, target)

    def load(batch: DataFrame, batch_id: int) -> None:
        fresh = keep_reports(batch, batch_id, target, suffix)
        done = _part(spark, f"{target}/samples", SAMPLES_SCHEMA).filter(F.col("batch_id") != batch_id)
        waiting = (
            _part(spark, f"{target}/reports", REPORTS_SCHEMA)
            .select("meth_sample_id")
            .join(done, "meth_sample_id", "left_anti")
        )
        named = lists()[2]
        touched = fresh.unionByName(waiting).distinct().join(named, "meth_sample_id", "left_semi")
        work_out(store(touched, "touched"), batch_id)

    lines = report_lines(spark, root, suffix, folders, stream=True)
    run_available(lines, load, checkpoint).awaitTermination()


def loaded(spark: SparkSession, target: str) -> DataFrame:
    """The table as loaded so far: of each sample the rows of its newest batch."""
    newest = (
        _part(spark, f"{target}/samples", SAMPLES_SCHEMA)
        .groupBy("meth_sample_id")
        .agg(F.max("batch_id").alias("batch_id"))
    )
    rows = _part(spark, f"{target}/rows", TABLE_SCHEMA)
    return rows.join(newest, ["meth_sample_id", "batch_id"]).select(
        "sample_id", "meth_sample_id", "probe_id", "value"
    )
