"""Writers.  All are single-pass and partitioned; none collects rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cpgspark.operators.qc import drop_probes, keep_probes
from cpgspark.operators.splits import MANIFEST_SCHEMA, RATIOS, SEED, manifest_counts
from cpgspark.plans.ordering import seeded_hash

SPLITS = ("train", "val", "test")
# Ids on one line of a written manifest, about.
IDS_PER_LINE = 1000


def scan_filter_sink(
    spark: SparkSession,
    source: str,
    target: str,
    keep: DataFrame,
    drop: DataFrame,
    fmt: str = "parquet",
) -> int:
    """Filter a Parquet table by two probe lists and write it; returns rows kept.

    The count comes from what was written: for Parquet from the file footers alone.
    The source is read once.
    """
    kept = keep_probes(drop_probes(spark.read.parquet(source), drop), keep)
    options = {"header": True} if fmt == "csv" else {}
    kept.write.format(fmt).options(**options).save(target)
    return spark.read.schema(kept.schema).format(fmt).options(**options).load(target).count()


def write_samples(values: DataFrame, target: str) -> None:
    """Per-sample M and Beta outputs: one folder per kind and sample.

    Rows are brought together by (kind, sample), so each task holds few open writers.
    Small samples give one file; a task never gets the whole of a large one.
    """
    (
        values.select("kind", "meth_sample_id", "probeName", "value")
        .hint("rebalance", "kind", "meth_sample_id")
        .write.mode("append")
        .partitionBy("kind", "meth_sample_id")
        .parquet(target)
    )


def written_samples(spark: SparkSession, target: str) -> DataFrame:
    """``meth_sample_id, kind`` of what :func:`write_samples` has written."""
    return (
        spark.read.schema("probeName string, value double, kind string, meth_sample_id string")
        .parquet(target)
        .select("meth_sample_id", "kind")
        .distinct()
    )


def write_measurements(m: DataFrame, target: str) -> None:
    """Long measurements, clustered by probe so that probe filters skip row groups."""
    (
        m.repartitionByRange("probe_id", "sample_id")
        .sortWithinPartitions("probe_id", "sample_id")
        .write.mode("append")
        .parquet(target)
    )


def long_to_wide(
    m: DataFrame, probes: Sequence[str] | None = None, as_map: bool | None = None
) -> DataFrame:
    """One row per sample: with ``as_map`` the known cells as ``values
    map<string,double>``, else a column for each listed probe.

    Columns are for lists that a table can have as columns; Spark plans each one.
    """
    as_map = probes is None if as_map is None else as_map
    if probes is None and not as_map:
        raise ValueError("columns need a list of probes")
    if not as_map:
        return m.groupBy("sample_id").pivot("probe_id", list(probes)).agg(F.max("value"))
    rows = m.filter(F.col("value").isNotNull())
    if probes is not None:
        listed = m.sparkSession.createDataFrame([(p,) for p in probes], "probe_id string")
        rows = keep_probes(rows, listed)
    entries = F.collect_list(F.struct("probe_id", "value"))
    return rows.groupBy("sample_id").agg(F.map_from_entries(entries).alias("values"))


def write_manifest(
    assignments: DataFrame,
    target: str,
    id_col: str,
    input_csv: str = "",
    ratios: Sequence[float] = RATIOS,
    seed: int = SEED,
) -> None:
    """Write a split as one JSON document, cut into the files of numbered folders.

    ``assignments`` is ``id_col, split``.  The lines of ``section=0/*, section=1/*, ...`` in
    the order of their names are the document: input, ratios, seed, id column, counts, and
    the ids of each split in the order of the seeded digest.  Odd sections hold ids, about
    a thousand on a line, so no task or row holds those of a whole split.
    """
    spark = assignments.sparkSession
    counts = manifest_counts(assignments)
    total = counts.first()["total"]
    digits = 0
    while IDS_PER_LINE * 16**digits < total:
        digits += 1
    settings = F.struct(
        F.lit(input_csv).alias("input_csv"),
        F.array(*[F.lit(float(r)) for r in ratios]).alias("ratios"),
        F.lit(seed).alias("seed"),
        F.lit(id_col).alias("id_col"),
        F.struct("total", *SPLITS).alias("counts"),
    )
    opened = F.regexp_replace(F.to_json(settings), "[}]$", ',"ids":{"train":[')
    head = counts.select(F.lit(0).alias("section"), F.lit("").alias("place"), opened.alias("line"))
    between = [(2, "", '],"val":['), (4, "", '],"test":['), (6, "", "]}}")]
    fixed = head.unionByName(spark.createDataFrame(between, "section int, place string, line string"))

    digest = F.coalesce(seeded_hash(id_col, seed), F.lit(""))
    section = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split")) * 2 - 1
    lines = (
        assignments.filter(F.col("split").isin(*SPLITS))
        .select(
            section.cast("int").alias("section"),
            F.substring(digest, 1, digits).alias("place") if digits else F.lit("").alias("place"),
            F.struct(digest.alias("digest"), F.col(id_col).cast("string").alias("id")).alias("entry"),
        )
        .groupBy("section", "place")
        .agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    )
    # One row per split: where its list begins without a comma.
    first = lines.groupBy("section").agg(F.min("place").alias("first"))
    ids = F.to_json(F.transform("entries", lambda e: e["id"]))
    text = F.concat(
        F.when(F.col("place") == F.col("first"), "").otherwise(","), F.regexp_extract(ids, r"(?s)^\[(.*)\]$", 1)
    )
    lists = lines.join(F.broadcast(first), "section").select("section", "place", text.alias("line"))
    ordered = fixed.unionByName(lists).orderBy("section", "place")
    ordered.select("section", "line").write.partitionBy("section").text(target)


def _manifest_lines(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("value string, section int").text(target)


def written_assignments(spark: SparkSession, target: str) -> DataFrame:
    """``sample_id, split`` of what :func:`write_manifest` has written, line by line."""
    ids = F.from_json(F.concat(F.lit("["), F.ltrim("value", F.lit(",")), F.lit("]")), "array<string>")
    names = F.array(*[F.lit(s) for s in SPLITS])
    return (
        _manifest_lines(spark, target)
        .filter(F.col("section") % 2 == 1)
        .select(F.explode(ids).alias("sample_id"), F.get(names, F.floor(F.col("section") / 2).cast("int")).alias("split"))
    )


def written_settings(spark: SparkSession, target: str) -> DataFrame:
    """One row: ``input_csv, ratios, seed, id_col, counts`` of a written manifest."""
    closed = F.concat("value", F.lit("]}}"))
    doc = _manifest_lines(spark, target).filter("section = 0")
    return doc.select(F.from_json(closed, MANIFEST_SCHEMA).alias("doc")).select("doc.*").drop("ids")
