"""Find samples that are new and add them to the measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cpgspark.plans.sizing import small_side

_FEATURE_BUCKETS = 64


def new_samples(reports: DataFrame, outputs: DataFrame) -> DataFrame:
    """Samples with a raw report that still lack the M or the Beta output.

    ``outputs`` holds ``meth_sample_id, kind``.
    """
    done = (
        outputs.filter(F.col("kind").isin("M", "Beta"))
        .groupBy("meth_sample_id")
        .agg(
            F.max(F.col("kind") == "M").alias("has_m"),
            F.max(F.col("kind") == "Beta").alias("has_beta"),
        )
        .filter("has_m AND has_beta")
    )
    return reports.join(done.select("meth_sample_id"), "meth_sample_id", "left_anti")


def unloaded_samples(extracted: DataFrame, loaded: DataFrame) -> DataFrame:
    """Extracted sample ids that the measurements do not hold yet."""
    ids = extracted.select("meth_sample_id").distinct()
    return ids.join(loaded.select("meth_sample_id"), "meth_sample_id", "left_anti")


def lookup_samples(samples: DataFrame, keys: DataFrame, key_col: str = "meth_sample_id") -> DataFrame:
    """Identifiers of the listed samples."""
    wanted = keys.select(key_col).distinct()
    return samples.join(wanted, key_col, "left_semi").select(
        "sample_id", "patient_id", "meth_sample_id"
    )


def convert_ids(samples: DataFrame, ids: DataFrame, source: str, target: str) -> DataFrame:
    """Translate ids from one name space to another; unknown ids give null."""
    return ids.select(source).join(
        samples.select(source, target).distinct(), source, "left"
    )


def _require_ids(incoming: DataFrame) -> None:
    lacking = [c for c in ("sample_id", "meth_sample_id") if c not in incoming.columns]
    unnamed = F.col("sample_id").isNull() | F.col("meth_sample_id").isNull()
    if lacking or incoming.filter(unnamed).limit(1).count():
        raise ValueError("every sample needs a sample_id and a meth_sample_id")


def append_samples(matrix: DataFrame, incoming: DataFrame, features: DataFrame) -> DataFrame:
    """Add the rows of samples that are not in the matrix, model features only.

    A feature the new sample lacks simply has no row: that is how missing is
    written in long form.
    """
    _require_ids(incoming)
    columns = ["sample_id", "meth_sample_id", "probe_id", "value"]
    known = matrix.select("meth_sample_id").distinct()
    fresh = (
        incoming.join(small_side(features.select("probe_id").distinct()), "probe_id", "left_semi")
        .join(known, "meth_sample_id", "left_anti")
        .select(*columns)
    )
    return matrix.select(*columns).unionByName(fresh)


def missing_probes(incoming: DataFrame, features: DataFrame) -> DataFrame:
    """The features each incoming sample lacks (no row or a null value).

    Features are cut into hash buckets; each sample meets each bucket through an
    equi-join, and only the difference of the two short lists is written out.
    """
    bucket = F.pmod(F.xxhash64("probe_id"), F.lit(_FEATURE_BUCKETS)).alias("bucket")
    wanted = (
        features.select("probe_id")
        .distinct()
        .groupBy(bucket)
        .agg(F.collect_list("probe_id").alias("wanted"))
    )
    held = (
        incoming.filter(F.col("value").isNotNull())
        .join(small_side(features.select("probe_id").distinct()), "probe_id", "left_semi")
        .groupBy("sample_id", bucket)
        .agg(F.collect_set("probe_id").alias("held"))
    )
    buckets = F.sequence(F.lit(0).cast("long"), F.lit(_FEATURE_BUCKETS - 1).cast("long"))
    slots = (
        incoming.select("sample_id")
        .distinct()
        .select("sample_id", F.explode(buckets).alias("bucket"))
    )
    lacking = F.array_except("wanted", F.coalesce("held", F.array().cast("array<string>")))
    return (
        slots.join(small_side(wanted, _FEATURE_BUCKETS), "bucket")
        .join(held, ["sample_id", "bucket"], "left")
        .select("sample_id", F.explode(lacking).alias("probe_id"))
    )
