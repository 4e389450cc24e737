"""Differential methylation and probe selection.

All statistics start from one aggregate per (probe, class): count, mean and the
sum of squared deviations, which Spark combines before the shuffle.  What follows
works on that small table, one short array of class moments per probe.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cpgspark.functions.tails import (
    digamma,
    f_upper,
    f_upper_tail,
    inverse_trigamma,
    log_variance_noise,
    log_variance_shift,
    student_t_p,
    winsorised_log_ratio,
)
from cpgspark.plans.durable import store
from cpgspark.plans.ordering import running_extreme, running_totals
from cpgspark.plans.sizing import small_side

ALPHA = 0.05
MIN_EFFECT = 0.3
MIN_GROUP = 3
TOP_PER_CLASS = 50


def class_sizes(labelled: DataFrame) -> DataFrame:
    """Samples per class among the measured, labelled samples."""
    samples = labelled.groupBy("sample_id").agg(F.first("class").alias("class"))
    return samples.groupBy("class").agg(F.count(F.lit(1)).alias("n_samples"))


def class_moments(labelled: DataFrame) -> DataFrame:
    """``probe_id, class, n, mean, m2`` over the known values."""
    return labelled.groupBy("probe_id", "class").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("m2"),
    )


def _merged(parts: Column) -> Column:
    """Pool an array of (n, mean, m2) moments without subtracting large sums."""
    known = F.filter(parts, lambda p: p["n"] > 0)
    n = F.aggregate(known, F.lit(0).cast("long"), lambda a, p: a + p["n"])
    total = F.aggregate(known, F.lit(0.0), lambda a, p: a + p["n"] * p["mean"])
    mean = F.when(n > 0, total / n)
    return F.struct(n.alias("n"), mean.alias("mean"), known.alias("parts"))


def _pooled_m2(pool: Column) -> Column:
    return F.aggregate(
        pool["parts"],
        F.lit(0.0),
        lambda a, p: a + p["m2"] + p["n"] * F.pow(p["mean"] - pool["mean"], F.lit(2)),
    )


def one_vs_rest(moments: DataFrame, classes: Column | None = None) -> DataFrame:
    """Each class against all others of the probe.

    The array per probe has one entry per class, so it is as short as the class
    list whatever the number of samples.  ``classes``, an array, limits the classes
    reported; the rest is always made of all of them.
    """
    entry = F.struct("class", "n", "mean", "m2")
    per_probe = moments.groupBy("probe_id").agg(F.collect_list(entry).alias("classes"))
    own = per_probe.select("probe_id", "classes", F.explode("classes").alias("own"))
    if classes is not None:
        own = own.filter(F.array_contains(classes, F.col("own.class")))
    others = F.filter("classes", lambda p: p["class"] != F.col("own.class"))
    return (
        own.withColumn("rest", _merged(others))
        .withColumn("rest_m2", _pooled_m2(F.col("rest")))
        .select(
            "probe_id",
            F.col("own.class").alias("class"),
            F.col("own.n").alias("n_class"),
            F.col("rest.n").alias("n_rest"),
            F.col("own.mean").alias("mean_class"),
            F.col("rest.mean").alias("mean_rest"),
            F.col("own.m2").alias("m2_class"),
            F.when(F.col("rest.n") > 0, F.col("rest_m2")).alias("m2_rest"),
        )
    )


def dm_class_stats(
    labelled: DataFrame, min_group: int = MIN_GROUP, sizes: DataFrame | None = None
) -> DataFrame:
    """Welch t, its degrees of freedom, the means and Cohen's d, class against rest.

    ``labelled`` is ``sample_id, probe_id, value, class``.  A class is skipped if it
    or its rest has fewer than ``min_group`` samples, known or not.  Give ``sizes``
    (see :func:`class_sizes`) where they are known, to save a pass over the ids.
    """
    sizes = class_sizes(labelled) if sizes is None else sizes
    # One row per class, turned into one array value: nothing is joined by class.
    everyone = Window.partitionBy()
    rest = F.sum("n_samples").over(everyone) - F.col("n_samples")
    allowed = (
        sizes.withColumn("rest", rest)
        .filter((F.col("n_samples") >= min_group) & (F.col("rest") >= min_group))
        .agg(F.collect_set("class").alias("classes"))
    )
    stats = one_vs_rest(class_moments(labelled), allowed.scalar())
    n, nr = F.col("n_class"), F.col("n_rest")
    var_c = F.when(n > 1, F.col("m2_class") / (n - 1))
    var_r = F.when(nr > 1, F.col("m2_rest") / (nr - 1))
    a, b = var_c / n, var_r / nr
    diff = F.col("mean_class") - F.col("mean_rest")
    spread = F.sqrt((var_c + var_r) / 2)
    t = F.when(a + b > 0, diff / F.sqrt(a + b))
    dof = F.when(a + b > 0, F.pow(a + b, F.lit(2)) / (a * a / (n - 1) + b * b / (nr - 1)))
    return stats.select(
        "probe_id",
        "class",
        "n_class",
        "n_rest",
        "mean_class",
        "mean_rest",
        t.alias("t"),
        dof.alias("df"),
        F.when(spread == 0, F.lit(0.0)).otherwise(diff / spread).alias("effect_size"),
    )


def welch_p(stats: DataFrame) -> DataFrame:
    """Add the two-sided p-value of ``t`` with ``df``."""
    return stats.withColumn("p_value", student_t_p(F.col("t"), F.col("df")))


def bh_fdr(
    stats: DataFrame, within: Sequence[str], p_col: str = "p_value", q_col: str = "q_value"
) -> DataFrame:
    """Benjamini-Hochberg q-values inside each group of ``within``; null p drop out.

    For groups that stay short, such as the classes of one probe.
    :func:`bh_fdr_large` takes groups of any size, or the whole table.
    """
    if not within:
        raise ValueError("give the group columns, or use bh_fdr_large")
    group = Window.partitionBy(*within)
    n = F.count(F.lit(1)).over(group)
    rank = F.row_number().over(group.orderBy(p_col))
    raw = F.col(p_col) * F.col("__n") / F.col("__rank")
    # From the largest p down, so that each row adds to a running minimum.
    best = F.min("__raw").over(
        group.orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        stats.filter(F.col(p_col).isNotNull())
        .withColumn("__n", n)
        .withColumn("__rank", rank)
        .withColumn("__raw", raw)
        .withColumn(q_col, F.least(best, F.lit(1.0)))
        .drop("__n", "__rank", "__raw")
    )


def bh_fdr_large(
    stats: DataFrame,
    within: Sequence[str] = (),
    p_col: str = "p_value",
    q_col: str = "q_value",
) -> DataFrame:
    """Benjamini-Hochberg q-values over the whole table or over groups of any size.

    Rows are first counted per distinct p; the rank of a p is its running count, and
    the running minimum from above is taken per bucket and then across buckets.
    """
    group = list(within)
    rows = stats.filter(F.col(p_col).isNotNull())
    ties = rows.groupBy(*group, p_col).agg(F.count(F.lit(1)).alias("__ties"))
    ranked = running_totals(ties, group, p_col, {"__ties": "__rank"}, descending=False)
    n = F.col("__rank_all")
    raw = ranked.withColumn("__raw", F.least(F.col(p_col) * n / F.col("__rank"), F.lit(1.0)))
    best = running_extreme(raw, group, "__rank", "__raw", q_col, largest=False, descending=True)
    q = best.select(*group, p_col, q_col)
    return rows.join(q, [*group, p_col])


def dm_best_class(stats: DataFrame, class_order: Sequence[str] | None = None) -> DataFrame:
    """Per probe the class with the least q, corrected across the probe's classes.

    Equal q go to the class that comes first in ``class_order`` (by name without it).
    """
    q = bh_fdr(stats, ["probe_id"])
    place = F.lit(0)
    if class_order is not None:
        listed = F.array(*[F.lit(c) for c in class_order])
        found = F.array_position(listed, F.col("class"))
        place = F.when(found > 0, found).otherwise(len(class_order) + 1)
    key = F.struct(F.col("q_value"), place.alias("place"), F.col("class"))
    row = F.struct("class", "p_value", "q_value", "effect_size")
    best = q.groupBy("probe_id").agg(F.min_by(row, key).alias("best"))
    return best.select(
        "probe_id",
        F.col("best.class").alias("best_class"),
        F.col("best.p_value").alias("best_p"),
        F.col("best.q_value").alias("best_q"),
        F.col("best.effect_size").alias("best_effect_size"),
    )


def dm_select(
    summary: DataFrame, alpha: float = ALPHA, min_effect: float = MIN_EFFECT
) -> DataFrame:
    """Probes with q and effect beyond the limits, best first."""
    return (
        summary.filter(
            (F.col("best_q") <= alpha) & (F.abs("best_effect_size") >= min_effect)
        )
        .select("probe_id", "best_class", "best_q", "best_effect_size")
        .orderBy(F.col("best_q"), F.col("best_effect_size").desc(), "probe_id")
    )


def differential_methylation(
    labelled: DataFrame, alpha: float = ALPHA, min_effect: float = MIN_EFFECT
) -> tuple[DataFrame, DataFrame]:
    """``(summary per probe, selected probes)`` from labelled measurements."""
    summary = dm_best_class(welch_p(dm_class_stats(labelled)))
    return summary, dm_select(summary, alpha, min_effect)


# A variance below this share of the class's median counts as that share of it.
VARIANCE_FLOOR = 1e-5


def moderated_stats(labelled: DataFrame, robust: bool = True) -> DataFrame:
    """Moderated one-vs-rest statistics: ``probe_id, class, t_mod, df_total, p_value``.

    Each class has its own prior variance, fitted by moments to the log variances
    of all its probes, tiny ones raised to a floor.  One row of moments per class
    reaches the driver.  With ``robust`` the moments are those of the winsorised log
    variances, so that a few probes of extreme variance do not widen the prior, and such
    probes get a looser prior of their own (:func:`outlier_priors`).  The degrees of
    freedom are at most those of all probes of the class pooled, so an infinite prior
    leaves a t tail.
    """
    stats = one_vs_rest(class_moments(labelled))
    n, nr = F.col("n_class"), F.col("n_rest")
    df = (n + nr - 2).cast("double")
    rows = stats.filter((n > 0) & (nr > 0) & (n + nr > 2)).select(
        "*", df.alias("df"), ((F.col("m2_class") + F.col("m2_rest")) / df).alias("s2")
    )
    # One row per probe and class, read twice below: the measurements only once.
    rows = store(rows, "moments")
    spread = rows.groupBy("class").agg(
        F.percentile_approx("s2", 0.5, 10_000).alias("middle"), F.sum("df").alias("df_pooled")
    )
    middle = F.when(F.col("middle") > 0, F.col("middle")).otherwise(1.0)
    # One row per class: read off once, as several steps below use it.
    spread = labelled.sparkSession.createDataFrame(spread.collect(), spread.schema)
    raised = rows.join(F.broadcast(spread), "class").withColumn(  # one row per class
        "s2", F.greatest("s2", VARIANCE_FLOOR * middle)
    )
    priors = _robust_priors(raised) if robust else _moment_priors(raised)
    prior = labelled.sparkSession.createDataFrame(
        priors, "class string, d0 double, s02 double"
    ).join(spread.select("class", "df_pooled"), "class")
    priored = rows.join(F.broadcast(prior), "class")  # one row per class
    if robust:
        own = outlier_priors(raised.select("probe_id", "class", "df", "s2"), prior)
        own = own.withColumnRenamed("d0", "own_d0")
        priored = priored.join(own, ["probe_id", "class"], "left")
        priored = priored.withColumn("d0", F.coalesce("own_d0", "d0"))
    d0, s02 = F.col("d0"), F.col("s02")
    pooled = F.when(d0 == float("inf"), s02).otherwise(
        (d0 * s02 + F.col("df") * F.col("s2")) / (d0 + F.col("df"))
    )
    t = (F.col("mean_class") - F.col("mean_rest")) / (
        F.sqrt(pooled) * F.sqrt(1 / F.col("n_class") + 1 / F.col("n_rest"))
    )
    return (
        priored.withColumn("t_mod", F.when(pooled > 0, t))
        .withColumn("df_total", F.least(d0 + F.col("df"), F.col("df_pooled")))
        .withColumn("p_value", student_t_p(F.col("t_mod"), F.col("df_total")))
        .select("probe_id", "class", "t_mod", "df_total", "p_value")
    )


def _moment_priors(rows: DataFrame) -> list[tuple[str, float, float]]:
    """``(class, d0, s02)`` from mean and variance of the log variances."""
    excess = F.log("s2") - log_variance_shift("df")
    moments = (
        rows.filter("s2 > 0")
        .select("class", excess.alias("e"), log_variance_noise("df").alias("noise"))
        .groupBy("class")
        .agg(F.avg("e").alias("centre"), F.var_samp("e").alias("var"), F.avg("noise").alias("noise"))
    )
    priors = []
    for r in moments.collect():
        surplus = (r["var"] or 0.0) - r["noise"]
        if surplus <= 0:
            priors.append((r["class"], float("inf"), math.exp(r["centre"])))
            continue
        half = inverse_trigamma(surplus)
        s02 = math.exp(r["centre"] + float(digamma(half)) - math.log(half))
        priors.append((r["class"], 2 * half, s02))
    return priors


# Shares of the log variances pulled in below and above.
WINSOR_TAILS = (0.05, 0.1)


def _robust_priors(rows: DataFrame) -> list[tuple[str, float, float]]:
    """``(class, d0, s02)`` that give the winsorised moments which are observed."""
    z = rows.filter("s2 > 0").select("class", "df", F.log("s2").alias("z"))
    cuts = F.percentile_approx("z", [WINSOR_TAILS[0], 1 - WINSOR_TAILS[1]], 10_000)
    limits = z.groupBy("class").agg(cuts.alias("cuts"))
    held = F.greatest(F.least("z", F.get("cuts", F.lit(1))), F.get("cuts", F.lit(0)))
    moments = (
        z.join(F.broadcast(limits), "class")  # one row per class
        .groupBy("class")
        .agg(F.avg(held).alias("mean"), F.var_samp(held).alias("var"), F.avg("df").alias("df"))
    )
    priors = []
    for r in moments.collect():
        low, high = 0.2, 1e4
        flat = winsorised_log_ratio(r["df"], high, WINSOR_TAILS)
        if (r["var"] or 0.0) <= flat[1]:
            priors.append((r["class"], float("inf"), math.exp(r["mean"] - flat[0])))
            continue
        for _ in range(30):  # the spread falls as the prior grows
            mid = math.sqrt(low * high)
            if winsorised_log_ratio(r["df"], mid, WINSOR_TAILS)[1] > r["var"]:
                low = mid
            else:
                high = mid
        d0 = math.sqrt(low * high)
        centre, _ = winsorised_log_ratio(r["df"], d0, WINSOR_TAILS)
        priors.append((r["class"], d0, math.exp(r["mean"] - centre)))
    return priors


def _median_df(ratio: float, df: float, d0: float) -> float:
    """Degrees of freedom, at most ``d0``, at which the ratio is the median of its F."""

    def above(d: float) -> float:
        return float(f_upper(ratio, df, d))

    low, high = 1e-6, min(d0, 1e6)
    if above(high) >= 0.5:
        return d0
    for _ in range(60):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if above(mid) >= 0.5 else (low, mid)
    return math.sqrt(low * high)


def outlier_priors(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """``probe_id, class, d0``: prior degrees of freedom of each probe of its own.

    ``rows`` is ``probe_id, class, df, s2``; ``prior``, one row per class, is ``class, d0,
    s02, df_pooled``.  The tail of a variance under the scaled F of its class, over the
    share of probes at least as extreme, tells how likely the probe is no outlier.  With
    that weight its degrees of freedom lie between the prior's and those for which the
    most extreme variance is a median.  They never rise towards the extremes: the most
    extreme probes share the least running mean, the others the running maximum.  Where
    the prior is infinite, an outlier gets its weight's part of the pooled ones.  Probes
    whose variance is no number get no row.

    One row per class reaches the driver; ranks and running values go by pieces.
    """
    ratio = F.col("s2") / F.col("s02")
    tails = (
        rows.join(F.broadcast(prior), "class")
        .withColumn("ratio", ratio)
        .withColumn("tail", f_upper_tail(F.col("ratio"), F.col("df"), F.col("d0")))
        .where("tail IS NOT NULL")
    )
    tails = store(tails.select("probe_id", "class", "tail", "ratio", "df"), "tails")
    extreme = tails.groupBy("class").agg(
        F.min_by(F.struct("ratio", "df"), F.struct("tail", -F.col("ratio"))).alias("top")
    )
    loosest = [
        (r["class"], _median_df(r["top"]["ratio"], r["top"]["df"], r["d0"]))
        for r in extreme.join(F.broadcast(prior), "class").collect()
    ]
    least = rows.sparkSession.createDataFrame(loosest, "class string, d_least double")
    ties = tails.groupBy("class", "tail").agg(F.count(F.lit(1)).alias("ties"))
    ranked = running_totals(ties, ["class"], "tail", {"ties": "rank"}, descending=False)
    share = (F.col("rank") - F.col("ties") / 2) / F.col("rank_all")
    weight = F.least(F.col("tail") / share, F.lit(1.0))
    mixed = F.when(weight >= 1, F.col("d0")).otherwise(
        F.when(F.col("d0") == float("inf"), weight * F.col("df_pooled")).otherwise(
            weight * F.col("d0") + (1 - weight) * F.col("d_least")
        )
    )
    own = (
        ranked.join(F.broadcast(prior), "class")  # one row per class, twice
        .join(F.broadcast(least), "class")
        .select("class", "tail", "rank", "ties", mixed.alias("own"))
        .withColumn("sum", F.col("own") * F.col("ties"))
    )
    means = running_totals(own, ["class"], "tail", {"sum": "so_far"}, descending=False)
    means = means.withColumn("mean", F.col("so_far") / F.col("rank"))
    lowest = means.groupBy("class").agg(
        F.min("mean").alias("floor"), F.min_by("rank", F.struct("mean", "rank")).alias("until")
    )
    held = means.join(F.broadcast(lowest), "class").withColumn(
        "own", F.when(F.col("rank") <= F.col("until"), F.col("floor")).otherwise(F.col("own"))
    )
    fallen = running_extreme(held, ["class"], "rank", "own", "d0").select("class", "tail", "d0")
    return tails.join(fallen, ["class", "tail"]).select("probe_id", "class", "d0")


def moderated_dm(
    labelled: DataFrame, top: int = TOP_PER_CLASS, robust: bool = True
) -> DataFrame:
    """The ``top`` probes of each class by moderated p; union over the classes."""
    stats = moderated_stats(labelled, robust)
    best = Window.partitionBy("class").orderBy(
        F.col("p_value").asc_nulls_last(), F.abs("t_mod").desc_nulls_last(), "probe_id"
    )
    return (
        stats.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= top)
        .select("probe_id")
        .distinct()
    )


def _zero_filled(parts: Column, size: Column) -> Column:
    """Moments of one class after its missing values are counted as 0."""
    known = F.get(F.filter(parts, lambda p: p["class"] == size["class"]), F.lit(0))
    n = size["n_samples"]
    held = F.coalesce(known["n"], F.lit(0))
    old = F.coalesce(known["mean"], F.lit(0.0))
    mean = old * held / n
    m2 = (
        F.coalesce(known["m2"], F.lit(0.0))
        + held * F.pow(old - mean, F.lit(2))
        + (n - held) * mean * mean
    )
    return F.struct(
        size["class"].alias("class"), n.alias("n"), mean.alias("mean"), m2.alias("m2")
    )


def anova_f(labelled: DataFrame, zero_fill: bool = False) -> DataFrame:
    """One-way F per probe over the classes.

    ``zero_fill`` counts a missing value as 0, as the cleaning step before the
    in-fold selector does, also where the row is absent.
    """
    entry = F.struct("class", "n", "mean", "m2")
    arrays = (
        class_moments(labelled).groupBy("probe_id").agg(F.collect_list(entry).alias("parts"))
    )
    if zero_fill:
        sizes = class_sizes(labelled).agg(F.collect_list(F.struct("class", "n_samples")))
        arrays = arrays.withColumn("sizes", sizes.scalar()).withColumn(
            "parts", F.transform("sizes", lambda s: _zero_filled(F.col("parts"), s))
        )
    return _f_of_parts(arrays, ["probe_id"])


def _f_of_parts(arrays: DataFrame, keep: Sequence[str]) -> DataFrame:
    """F of every row from ``parts``, its array of class moments."""
    arrays = arrays.withColumn("parts", F.filter("parts", lambda p: p["n"] > 0))
    pooled = arrays.withColumn("pool", _merged(F.col("parts")))
    within = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["m2"])
    between = F.aggregate(
        "parts",
        F.lit(0.0),
        lambda a, p: a + p["n"] * F.pow(p["mean"] - F.col("pool.mean"), F.lit(2)),
    )
    k = F.size("parts")
    n = F.col("pool.n")
    return (
        pooled.withColumn("within", within)
        .withColumn("between", between)
        .withColumn("df_between", (k - 1).cast("long"))
        .withColumn("df_within", n - k)
        .withColumn(
            "f_score",
            F.when(
                (F.col("df_between") > 0) & (F.col("df_within") > 0) & (F.col("within") > 0),
                (F.col("between") / F.col("df_between")) / (F.col("within") / F.col("df_within")),
            ),
        )
        .select(*keep, "f_score", "df_between", "df_within")
    )


#: Stands for no fold: the scores over all training rows.
ALL_FOLDS = -1


def fold_scores(
    m: DataFrame, cohort: DataFrame, zero_fill: bool = True, complete: bool = False
) -> DataFrame:
    """F per probe on the training part of every fold of every node, in one pass.

    ``cohort`` is ``node, sample_id, class, fold``; rows of a null fold train nothing.  Gives
    ``node, left_out, probe_id, f_score, df_between, df_within``: the scores over the rows
    of all folds but ``left_out``, and over all of them for :data:`ALL_FOLDS`.

    The measurements go into one aggregate keyed by (node, probe, class, fold); a
    training part merges the moments of its folds, an array of at most classes times
    folds per probe.  ``zero_fill`` counts missing values as 0.  ``complete`` keeps the
    probes that every sample of the node has, those of a null fold included.
    """
    moments = (
        m.join(small_side(cohort), "sample_id")
        .groupBy("node", "probe_id", "class", "fold")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            (F.var_pop("value") * F.count("value")).alias("m2"),
        )
    )
    cells = moments.groupBy("node", "probe_id").agg(
        F.collect_list(F.struct("class", "fold", "n", "mean", "m2")).alias("cells")
    )
    if complete:
        known = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])
        everyone = cohort.groupBy("node").agg(F.count(F.lit(1)).alias("everyone"))
        cells = cells.join(small_side(everyone), "node").where(known == F.col("everyone"))
    # One row for each node, class and fold.
    counted = cohort.where("fold IS NOT NULL").groupBy("node", "class", "fold").count()
    parts = counted.select("node", F.col("fold").alias("left_out")).distinct()
    parts = parts.unionByName(parts.select("node", F.lit(ALL_FOLDS).alias("left_out")).distinct())
    sizes = (
        counted.join(parts, "node")
        .where("fold != left_out")
        .groupBy("node", "left_out", "class")
        .agg(F.sum("count").alias("n_samples"))
        .groupBy("node", "left_out")
        .agg(F.array_sort(F.collect_list(F.struct("class", "n_samples"))).alias("sizes"))
    )

    def trains(size: Column):
        return lambda c: (
            (c["class"] == size["class"]) & c["fold"].isNotNull() & (c["fold"] != F.col("left_out"))
        )

    def part(held: Column) -> Column:
        pool, size = held["pool"], held["size"]
        merged = F.struct(
            size["class"].alias("class"),
            pool["n"].alias("n"),
            pool["mean"].alias("mean"),
            _pooled_m2(pool).alias("m2"),
        )
        return _zero_filled(F.array(merged), size) if zero_fill else merged

    pooled = F.transform(
        "sizes",
        lambda s: F.struct(s.alias("size"), _merged(F.filter("cells", trains(s))).alias("pool")),
    )
    arrays = cells.join(small_side(sizes), "node").select("node", "left_out", "probe_id", pooled.alias("held"))
    arrays = arrays.withColumn("parts", F.transform("held", part))
    return _f_of_parts(arrays, ["node", "left_out", "probe_id"])


def fold_features(scores: DataFrame, k: int | None = 5000) -> DataFrame:
    """``node, left_out, place, probe_id``: the k probes of the highest F of each part."""
    best = Window.partitionBy("node", "left_out").orderBy(
        F.col("f_score").desc_nulls_last(), "probe_id"
    )
    placed = scores.select(
        "node", "left_out", F.row_number().over(best).alias("place"), "probe_id", "f_score"
    )
    return placed if k is None else placed.where(F.col("place") <= int(k))


def select_k_best(scores: DataFrame, k: int | None = 5000) -> DataFrame:
    """The k probes of the highest F; all of them for ``None``."""
    if k is None:
        return scores
    return scores.orderBy(F.col("f_score").desc_nulls_last(), "probe_id").limit(int(k))


_PROBE_NAMES = ("probe_id", "probe", "feature", "id")
_P_NAMES = ("p_value", "pvalue", "pval")
_SAMPLE_NAMES = ("biosample_id", "sample_id")


def _named(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def precomputed_select(
    stats: DataFrame | None,
    selected: DataFrame | None,
    available: DataFrame,
    top_k: int | None = 5000,
) -> DataFrame:
    """``probe_id, place`` from stored statistics and a stored selection.

    The ``top_k`` by p are cut to the stored selection and to the probes present;
    order is by p.  Without a p column the selection alone decides, by name.  A
    selection with a sample-id column is a matrix whose other columns are probes.
    """
    probes = None
    if stats is not None and top_k:
        probe_col, p_col = _named(stats, _PROBE_NAMES), _named(stats, _P_NAMES)
        if probe_col and p_col:
            probes = (
                stats.select(
                    F.col(probe_col).cast("string").alias("probe_id"), F.col(p_col).alias("p")
                )
                .dropna()
                .orderBy("p", "probe_id")
                .limit(int(top_k))
            )
    if selected is not None:
        sample_col = _named(selected, _SAMPLE_NAMES)
        if sample_col:
            names = [(c,) for c in selected.columns if c != sample_col]
            listed = selected.sparkSession.createDataFrame(names, "probe_id string")
        else:
            name = _named(selected, _PROBE_NAMES) or selected.columns[0]
            listed = selected.select(F.col(name).cast("string").alias("probe_id"))
        if probes is None:
            probes = listed.withColumn("p", F.lit(None).cast("double"))
        else:
            probes = probes.join(listed, "probe_id", "left_semi")
    if probes is None:
        probes = available.select("probe_id").distinct().withColumn("p", F.lit(None).cast("double"))
    present = available.select("probe_id").distinct()
    kept = probes.join(present, "probe_id", "left_semi")
    # One row per selected probe: no larger than the array.
    order = Window.orderBy(F.col("p").asc_nulls_last(), "probe_id")
    return kept.select("probe_id", F.row_number().over(order).alias("place"))


def restrict_to(m: DataFrame, probes: DataFrame) -> DataFrame:
    """Measurements of the listed probes only."""
    return m.join(small_side(probes.select("probe_id").distinct()), "probe_id", "left_semi")
