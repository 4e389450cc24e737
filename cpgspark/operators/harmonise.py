"""Bring second-generation array probes onto first-generation loci."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cpgspark.plans.sizing import small_side

# Replicate counts that are resolved, and the result texts.
REPLICATE_SIZES = (2, 3, 4, 5, 6, 10)
SUPERIOR_TEXT = "Superior probe"
BEST_TEXT = "Best"


def replicate_counts(manifest: DataFrame) -> DataFrame:
    """How many loci have each number of probes."""
    per_locus = manifest.groupBy("EPICv1locmatch").agg(
        F.count("EPICv1locmatch").alias("replicates")
    )
    return per_locus.groupBy("replicates").agg(F.count("EPICv1locmatch").alias("num_loci"))


def _locus_rules(manifest: DataFrame, replicate_sizes: Sequence[int]) -> DataFrame:
    """Per locus with a listed replicate count: which rule decides it."""
    result = F.col("Rep_results_by_NAME")
    return (
        manifest.groupBy("EPICv1locmatch")
        .agg(
            F.count("EPICv1locmatch").alias("replicates"),
            F.max(F.coalesce(result == SUPERIOR_TEXT, F.lit(False))).alias("superior"),
            F.max(F.coalesce(result.contains(BEST_TEXT), F.lit(False))).alias("best"),
        )
        .filter(F.col("replicates").isin(*replicate_sizes))
    )


def probe_map(
    manifest: DataFrame, replicate_sizes: Sequence[int] = REPLICATE_SIZES
) -> DataFrame:
    """Locus and the list of probes whose mean stands for it.

    The probes called superior win; without any, the probes called best.
    """
    result = F.col("Rep_results_by_NAME")
    deciding = F.when(F.col("superior"), result == SUPERIOR_TEXT).otherwise(
        result.contains(BEST_TEXT)
    )
    rules = _locus_rules(manifest, replicate_sizes).filter("superior OR best")
    # A listed locus has at most ten probes, so the list is short by construction.
    return (
        manifest.join(rules, "EPICv1locmatch")
        .filter(deciding)
        .groupBy("EPICv1locmatch")
        .agg(F.sort_array(F.collect_list("IlmnID")).alias("IlmnID"))
    )


def probe_map_unresolved(
    manifest: DataFrame, replicate_sizes: Sequence[int] = REPLICATE_SIZES
) -> DataFrame:
    """Manifest rows of listed loci for which neither rule finds a probe."""
    undecided = _locus_rules(manifest, replicate_sizes).filter("NOT superior AND NOT best")
    return manifest.join(undecided.select("EPICv1locmatch"), "EPICv1locmatch", "left_semi")


def replace_with_mean(reports: DataFrame, mapping: DataFrame, value_col: str) -> DataFrame:
    """Give all rows of a mapped locus the mean over its chosen probes.

    ``reports`` holds ``meth_sample_id, Name, EPICv1_Loci`` and the value.  All
    samples are done by one join.  A locus none of whose chosen probes is in the
    sample keeps its values.
    """
    rows = reports.filter(F.col("EPICv1_Loci").isNotNull())
    chosen = mapping.select(
        F.col("EPICv1locmatch").alias("EPICv1_Loci"), F.explode("IlmnID").alias("Name")
    )
    means = (
        rows.select("meth_sample_id", "Name", value_col)
        .join(small_side(chosen), "Name")
        .groupBy("meth_sample_id", "EPICv1_Loci")
        .agg(F.avg(value_col).alias("__mean"), F.lit(True).alias("__found"))
    )
    value = F.when(F.col("__found"), F.col("__mean")).otherwise(F.col(value_col))
    return (
        rows.join(means, ["meth_sample_id", "EPICv1_Loci"], "left")
        .withColumn(value_col, value)
        .drop("__mean", "__found")
    )


def resolve_loci(rows: DataFrame, value_col: str) -> DataFrame:
    """One row per (sample, locus); a locus with two different values is dropped.

    Null counts as a value of its own.  Written as minimum, maximum and counts,
    which combine before the shuffle, instead of a distinct plus a window.
    """
    v = F.col(value_col)
    stats = rows.groupBy("meth_sample_id", "EPICv1_Loci").agg(
        F.min(v).alias("__low"),
        F.max(v).alias("__high"),
        F.count(v).alias("__known"),
        F.count(F.lit(1)).alias("__rows"),
    )
    single = (F.col("__known") == 0) | (
        (F.col("__known") == F.col("__rows")) & (F.col("__low") == F.col("__high"))
    )
    return stats.filter(single).select(
        "meth_sample_id", "EPICv1_Loci", F.col("__low").alias(value_col)
    )


def harmonise_v2(
    reports: DataFrame, mapping: DataFrame, value_cols: Sequence[str]
) -> DataFrame:
    """Second-generation reports to ``meth_sample_id, probeName, column, value``.

    The same rows as :func:`replace_with_mean` and :func:`resolve_loci` for each
    column, in one pass for all columns: a locus with a chosen probe takes their
    mean, any other must have a single value.  Both sides are aggregated by (sample,
    locus) before they meet, so the raw rows are never shuffled for the join.
    """
    rows = reports.filter(F.col("EPICv1_Loci").isNotNull())
    chosen = mapping.select(
        F.col("EPICv1locmatch").alias("EPICv1_Loci"), F.explode("IlmnID").alias("Name")
    )
    keys = ["meth_sample_id", "EPICv1_Loci"]
    means = (
        rows.select("meth_sample_id", "Name", *value_cols)
        .join(small_side(chosen), "Name")
        .groupBy(*keys)
        .agg(F.lit(True).alias("found"), *[F.avg(c).alias(f"mean_{c}") for c in value_cols])
    )
    sizes = [F.count(F.lit(1)).alias("rows")]
    for c in value_cols:
        sizes += [F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"), F.count(c).alias(f"n_{c}")]
    joined = rows.groupBy(*keys).agg(*sizes).join(means, keys, "left")

    def cell(c: str) -> Column:
        n, low = F.col(f"n_{c}"), F.col(f"low_{c}")
        single = (n == 0) | ((n == F.col("rows")) & (low == F.col(f"high_{c}")))
        found = F.coalesce("found", F.lit(False))
        return F.struct(
            F.lit(c).alias("column"),
            F.when(found, F.col(f"mean_{c}")).otherwise(low).alias("value"),
            (found | single).alias("kept"),
        )

    cells = F.explode(F.array(*[cell(c) for c in value_cols]))
    return (
        joined.select(*keys, cells.alias("c"))
        .filter("c.kept")
        .select("meth_sample_id", F.col("EPICv1_Loci").alias("probeName"), "c.column", "c.value")
    )


# Output kinds and the report columns they come from.
KINDS = {"M": "MValue", "Beta": "Beta"}


def harmonise(
    v2_reports: DataFrame | None, v1_reports: DataFrame | None, mapping: DataFrame
) -> DataFrame:
    """All reports to long rows ``kind, meth_sample_id, probeName, value``.

    ``kind`` is ``M`` or ``Beta``.  First-generation reports are only renamed; one
    without an ``MValue`` column is skipped.
    """
    names = {column: kind for kind, column in KINDS.items()}
    parts: list[DataFrame] = []
    if v2_reports is not None:
        values = harmonise_v2(v2_reports, mapping, list(names))
        kind = F.when(F.col("column") == KINDS["M"], "M").otherwise("Beta")
        parts.append(values.select(kind.alias("kind"), "meth_sample_id", "probeName", "value"))
    if v1_reports is not None and KINDS["M"] in v1_reports.columns:
        both = F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"))
                for kind, column in KINDS.items()
            ]
        )
        parts.append(
            v1_reports.select(
                "meth_sample_id", F.col("Name").alias("probeName"), F.explode(both).alias("c")
            ).select("c.kind", "meth_sample_id", "probeName", "c.value")
        )
    if not parts:
        raise ValueError("no report with an MValue column")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
