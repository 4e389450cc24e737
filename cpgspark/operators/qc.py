"""Sample and probe quality filters over long measurements.

Input ``m`` is ``sample_id, probe_id, value`` with at most one row per cell.  A
cell is missing when its value is null *or* its row is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.ml.functions import vector_to_array

from cpgspark.functions.numeric import clean_numeric, finite
from cpgspark.plans.sizing import small_side

# Chromosomes left out and the reason names of the problem list.
SEX_AND_MITO = ("chrX", "chrY", "chrM")
SNP_REASON = "Polymorphism"
CROSS_HYBRID_REASON = "CrossHybridization"
MAX_MISSING = 50_000
MIN_PURITY = 0.30


def gene_probes(meta: DataFrame) -> DataFrame:
    return meta.filter(F.col("gencodebasic_name").isNotNull()).select("probe_id").distinct()


def xym_probes(meta: DataFrame) -> DataFrame:
    return meta.filter(F.col("chr_hg38").isin(*SEX_AND_MITO)).select("probe_id").distinct()


def problem_probes(problems: DataFrame, reason: str) -> DataFrame:
    return problems.filter(F.col("reason") == reason).select("probe_id").distinct()


def keep_probes(m: DataFrame, probes: DataFrame) -> DataFrame:
    return m.join(small_side(probes), "probe_id", "left_semi")


def drop_probes(m: DataFrame, probes: DataFrame) -> DataFrame:
    return m.join(small_side(probes), "probe_id", "left_anti")


def keep_gene_probes(m: DataFrame, meta: DataFrame) -> DataFrame:
    """Keep probes that lie in a gene."""
    return keep_probes(m, gene_probes(meta))


def drop_xym_probes(m: DataFrame, meta: DataFrame) -> DataFrame:
    """Drop probes on the sex chromosomes and the mitochondrion."""
    return drop_probes(m, xym_probes(meta))


def drop_snp_probes(m: DataFrame, problems: DataFrame) -> DataFrame:
    """Drop probes next to a polymorphism."""
    return drop_probes(m, problem_probes(problems, SNP_REASON))


def drop_cross_hybrid(m: DataFrame, problems: DataFrame) -> DataFrame:
    """Drop probes that hybridise elsewhere."""
    return drop_probes(m, problem_probes(problems, CROSS_HYBRID_REASON))


def _n_distinct(m: DataFrame, column: str) -> Column:
    return m.agg(F.countDistinct(column).alias("n")).scalar()


def drop_sparse_samples(m: DataFrame, max_missing: int = MAX_MISSING) -> DataFrame:
    """Keep samples that lack at most ``max_missing`` of the probes in ``m``."""
    present = m.groupBy("sample_id").agg(F.count("value").alias("present"))
    kept = present.filter(_n_distinct(m, "probe_id") - F.col("present") <= max_missing)
    return m.join(kept.select("sample_id"), "sample_id", "left_semi")


def complete_probes(m: DataFrame) -> DataFrame:
    """``probe_id`` of every probe that no sample of ``m`` lacks."""
    present = m.groupBy("probe_id").agg(F.count("value").alias("present"))
    return present.filter(F.col("present") == _n_distinct(m, "sample_id")).select("probe_id")


def drop_incomplete_probes(m: DataFrame) -> DataFrame:
    """Drop every probe that any sample of ``m`` lacks."""
    return m.join(complete_probes(m), "probe_id", "left_semi")


def drop_incomplete_samples(m: DataFrame) -> DataFrame:
    """Drop every sample that lacks any probe of ``m``."""
    return drop_sparse_samples(m, max_missing=0)


def drop_nonfinite_probes(m: DataFrame) -> DataFrame:
    """Treat NaN and infinities as missing, then drop incomplete probes."""
    return drop_incomplete_probes(m.withColumn("value", finite(F.col("value"))))


def clean_values(m: DataFrame) -> DataFrame:
    """Numbers only, missing as 0, single precision."""
    return m.withColumn("value", clean_numeric(F.col("value")))


def filter_all(
    m: DataFrame, meta: DataFrame, problems: DataFrame, max_missing: int = MAX_MISSING
) -> DataFrame:
    """Gene, chromosome, sparse-sample, polymorphism, cross-hybrid filter, in order.

    Sparse samples are judged on the probes left by the first two filters only, so
    the order matters and is kept.
    """
    m = drop_xym_probes(keep_gene_probes(m, meta), meta)
    m = drop_sparse_samples(m, max_missing)
    return drop_cross_hybrid(drop_snp_probes(m, problems), problems)


STEPS = ("gene_probes", "xym_probes", "sparse_samples", "snp_probes", "cross_hybrid")


def filter_report(
    m: DataFrame, meta: DataFrame, problems: DataFrame, max_missing: int = MAX_MISSING
) -> DataFrame:
    """Samples and probes before and after each step of :func:`filter_all`.

    Each row of ``m`` is marked once with the number of steps it survives; one
    aggregate per axis then gives every line of the report.
    """

    def marked(frame: DataFrame, probes: DataFrame, name: str) -> DataFrame:
        flags = probes.select("probe_id", F.lit(True).alias(name))
        return frame.join(small_side(flags), "probe_id", "left").withColumn(
            name, F.coalesce(name, F.lit(False))
        )

    flagged = marked(m, gene_probes(meta), "gene")
    flagged = marked(flagged, xym_probes(meta), "xym")
    flagged = marked(flagged, problem_probes(problems, SNP_REASON), "snp")
    flagged = marked(flagged, problem_probes(problems, CROSS_HYBRID_REASON), "cross")

    located = flagged.filter(F.col("gene") & ~F.col("xym"))
    present = located.groupBy("sample_id").agg(F.count("value").alias("present"))
    dense = present.filter(
        _n_distinct(located, "probe_id") - F.col("present") <= max_missing
    ).select("sample_id", F.lit(True).alias("dense"))
    flagged = flagged.join(dense, "sample_id", "left").withColumn(
        "dense", F.coalesce("dense", F.lit(False))
    )

    passed = [F.col("gene"), ~F.col("xym"), F.col("dense"), ~F.col("snp"), ~F.col("cross")]
    survived = F.lit(len(passed))
    for step in reversed(range(len(passed))):
        survived = F.when(passed[step], survived).otherwise(F.lit(step))
    scored = flagged.withColumn("survived", survived)

    def left_after(axis: str, name: str) -> DataFrame:
        best = scored.groupBy(axis).agg(F.max("survived").alias("survived"))
        steps = F.explode(F.sequence(F.lit(0), F.col("survived"))).alias("step_no")
        return best.select(steps).groupBy("step_no").agg(F.count(F.lit(1)).alias(name))

    numbers = m.sparkSession.range(0, len(STEPS) + 1).select(
        F.col("id").cast("int").alias("step_no")
    )
    sizes = (
        numbers.join(left_after("sample_id", "samples_after"), "step_no", "left")
        .join(left_after("probe_id", "probes_after"), "step_no", "left")
        .fillna(0, ["samples_after", "probes_after"])
    )
    # Six rows: one line per step.
    w = Window.orderBy("step_no")
    names = F.array(*[F.lit(s) for s in STEPS])
    return (
        sizes.withColumn("samples_before", F.lag("samples_after").over(w))
        .withColumn("probes_before", F.lag("probes_after").over(w))
        .filter("step_no > 0")
        .select(
            F.element_at(names, F.col("step_no")).alias("step"),
            "step_no",
            "samples_before",
            "probes_before",
            "samples_after",
            "probes_after",
            (F.col("samples_before") - F.col("samples_after")).alias("samples_removed"),
            (F.col("probes_before") - F.col("probes_after")).alias("probes_removed"),
        )
    )


def purity_filter(
    samples: DataFrame, purity: DataFrame, min_purity: float = MIN_PURITY
) -> DataFrame:
    """Keep samples whose tumour purity is known and above ``min_purity``."""
    pure = purity.filter(F.col("purity") > min_purity)
    return samples.join(
        pure.select(F.col("biosample_id").alias("sample_id")), "sample_id", "left_semi"
    )


def correct_calls(predictions: DataFrame) -> DataFrame:
    """Right calls with the probability of the called class.

    ``predictions`` holds ``actual, predicted`` and ``probability``, which is the
    probability vector of a model, an array, or already one number.
    """
    kind = dict(predictions.dtypes)["probability"]
    p = F.col("probability")
    if kind == "vector":
        p = F.array_max(vector_to_array(p))
    elif kind.startswith("array"):
        p = F.array_max(p)
    return predictions.filter(F.col("actual") == F.col("predicted")).withColumn("probability", p)
