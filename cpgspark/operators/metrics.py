"""Evaluation tables from predictions.

Everything but the curves is arithmetic on one confusion table, which Spark counts
with a partial aggregate and which has at most classes x classes rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cpgspark.plans.ordering import running_totals


def confusion_counts(pred: DataFrame) -> DataFrame:
    """``actual, predicted, n`` of the pairs that occur."""
    return pred.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _class_counts(pred: DataFrame) -> DataFrame:
    """Per label of either side: true positives, support, times predicted."""
    cells = confusion_counts(pred)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("actual").alias("class"),
                    F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                    .otherwise(0)
                    .alias("tp"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("called"),
                ),
                F.struct(
                    F.col("predicted").alias("class"),
                    F.lit(0).cast("long").alias("tp"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("called"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    return sides.groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called")
    )


def _safe(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def core_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy, macro F1 and balanced accuracy, six decimals, one row."""
    c = _class_counts(pred)
    f1 = _safe(2 * F.col("tp"), F.col("support") + F.col("called"))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    return c.agg(
        F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"),
        F.round(F.avg(f1), 6).alias("f1_macro"),
        F.round(F.avg(recall), 6).alias("balanced_accuracy"),
    )


def confusion_matrix(pred: DataFrame, classes: Sequence[str] | DataFrame) -> DataFrame:
    """All pairs of listed classes with count and row share.

    ``classes`` is a list, or a frame with the label column ``class``.  Pairs with
    an unlisted label are dropped; a class without rows has shares of 0.
    """
    if isinstance(classes, DataFrame):
        labels = classes.agg(F.collect_set("class").alias("labels"))
    else:
        labels = pred.sparkSession.range(1).select(
            F.array(*[F.lit(c) for c in classes]).alias("labels")
        )
    grid = labels.select("labels", F.explode("labels").alias("actual")).select(
        "actual", F.explode("labels").alias("predicted")
    )
    counted = grid.join(confusion_counts(pred), ["actual", "predicted"], "left").fillna(0, ["n"])
    row = F.sum("n").over(Window.partitionBy("actual"))
    return counted.withColumn("share", F.col("n") / F.greatest(row, F.lit(1)))


def class_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, and their averages.

    Rows ``accuracy``, ``macro avg`` and ``weighted avg`` follow the classes; the
    accuracy row bears the same number in all three columns.
    """
    precision = _safe(F.col("tp"), F.col("called"))
    recall = _safe(F.col("tp"), F.col("support"))
    f1 = _safe(2 * F.col("tp"), F.col("support") + F.col("called"))
    per_class = _class_counts(pred).select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1_score"),
        "support",
        "tp",
    )
    names = ("precision", "recall", "f1_score")
    total = F.sum("support")
    summary = per_class.agg(
        total.alias("support"),
        (F.sum("tp") / total).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}") for c in names],
    )
    rows = F.array(
        F.struct(
            F.lit("accuracy").alias("class"),
            *[F.col("accuracy").alias(c) for c in names],
            F.col("support"),
        ),
        F.struct(
            F.lit("macro avg").alias("class"),
            *[F.col(f"macro_{c}").alias(c) for c in names],
            F.col("support"),
        ),
        F.struct(
            F.lit("weighted avg").alias("class"),
            *[F.col(f"weighted_{c}").alias(c) for c in names],
            F.col("support"),
        ),
    )
    averages = summary.select(F.explode(rows).alias("r")).select("r.*")
    return per_class.drop("tp").unionByName(averages)


def class_youden(pred: DataFrame) -> DataFrame:
    """Sensitivity, specificity and Youden index of each true class."""
    everyone = Window.partitionBy()
    c = _class_counts(pred).withColumn("total", F.sum("support").over(everyone))
    tp, fn = F.col("tp"), F.col("support") - F.col("tp")
    fp = F.col("called") - F.col("tp")
    tn = F.col("total") - tp - fn - fp
    sensitivity = _safe(tp, tp + fn)
    specificity = _safe(tn, tn + fp)
    return c.filter("support > 0").select(
        "class",
        sensitivity.alias("sensitivity"),
        specificity.alias("specificity"),
        (sensitivity + specificity - 1).alias("youden_index"),
        sensitivity.alias("balanced_accuracy"),
    )


def one_vs_rest_scores(pred: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``class, truth, score`` for each listed class from ``actual`` and an array
    ``scores`` in the order of ``classes``."""
    pairs = F.arrays_zip(
        F.array(*[F.lit(c) for c in classes]).alias("class"), F.col("scores").alias("score")
    )
    return pred.select("actual", F.explode(pairs).alias("p")).select(
        F.col("p.class").alias("class"),
        (F.col("actual") == F.col("p.class")).cast("int").alias("truth"),
        F.col("p.score").alias("score"),
    )


def threshold_counts(scored: DataFrame) -> DataFrame:
    """True and false positives at every distinct score of every class.

    Ties are merged by an aggregate first; the running sums are then taken over
    score buckets, so one class or a third of all rows is no single task.  Classes
    without positives or without negatives are left out.
    """
    points = scored.groupBy("class", "score").agg(
        F.sum(F.col("truth").cast("long")).alias("pos"),
        F.sum(1 - F.col("truth").cast("long")).alias("neg"),
    )
    sums = running_totals(points, ["class"], "score", {"pos": "tp", "neg": "fp"})
    return sums.filter((F.col("tp_all") > 0) & (F.col("fp_all") > 0)).drop("pos", "neg")


def roc_curve(scored: DataFrame) -> DataFrame:
    """``class, threshold, fpr, tpr`` at every distinct score, and the origin.

    The origin has an infinite threshold, as nothing is called there.
    """
    c = threshold_counts(scored)
    points = c.select(
        "class",
        F.col("score").alias("threshold"),
        (F.col("fp") / F.col("fp_all")).alias("fpr"),
        (F.col("tp") / F.col("tp_all")).alias("tpr"),
    )
    origin = points.select("class").distinct().select(
        "class",
        F.lit(float("inf")).alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(origin)


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the curve per class; ties count one half.

    The trapezoid over a score with (pos, neg) rows is neg * (tp - pos / 2), so the
    area is one plain sum: no step needs its neighbour.
    """
    points = scored.groupBy("class", "score").agg(
        F.sum(F.col("truth").cast("long")).alias("pos"),
        F.sum(1 - F.col("truth").cast("long")).alias("neg"),
    )
    sums = running_totals(points, ["class"], "score", {"pos": "tp", "neg": "fp"})
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return (
        sums.groupBy("class")
        .agg(area.alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        .filter("p > 0 AND n > 0")
        .select("class", (F.col("area") / (F.col("p") * F.col("n"))).alias("roc_auc"))
    )


def pr_curve(scored: DataFrame) -> DataFrame:
    """``class, threshold, precision, recall`` at every distinct score, and the end
    point of recall 0 and precision 1."""
    c = threshold_counts(scored)
    points = c.select(
        "class",
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("tp_all")).alias("recall"),
    )
    end = points.select("class").distinct().select(
        "class",
        F.lit(float("inf")).alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def brier(scored: DataFrame) -> DataFrame:
    """Mean squared error of the positive probability, one row."""
    return scored.agg(F.avg(F.pow(F.col("score") - F.col("truth"), F.lit(2))).alias("brier_score"))


def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per class: accuracy of the thresholded score, ROC area and Brier score."""
    called = (F.col("score") >= threshold).cast("int")
    simple = scored.groupBy("class").agg(
        F.avg((called == F.col("truth")).cast("double")).alias("accuracy"),
        F.avg(F.pow(F.col("score") - F.col("truth"), F.lit(2))).alias("brier_score"),
    )
    return simple.join(roc_auc(scored), "class", "left")  # one row per class


def share_above(values: DataFrame, column: str, threshold: float) -> DataFrame:
    """Fraction of values above the threshold, 0 for none at all."""
    above = F.avg((F.col(column) > threshold).cast("double"))
    return values.agg(F.coalesce(above, F.lit(0.0)).alias("share"))


def correct_call_distribution(calls: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram of the probability of right calls per class, with class moments.

    ``calls`` is the result of ``correct_calls``.  The bin is closed on the right
    end of the scale only.
    """
    slot = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    cells = calls.groupBy(F.col("predicted").alias("class"), slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("probability").alias("low"),
        F.max("probability").alias("high"),
        F.sum("probability").alias("total"),
    )
    cls = Window.partitionBy("class")  # at most `bins` rows per class
    return cells.select(
        "class",
        "bin",
        "n",
        (F.col("n") / F.sum("n").over(cls)).alias("share"),
        F.min("low").over(cls).alias("min_probability"),
        F.max("high").over(cls).alias("max_probability"),
        (F.sum("total").over(cls) / F.sum("n").over(cls)).alias("mean_probability"),
    )


def metrics_summary(
    val: DataFrame, test: DataFrame | None = None, cv_best: float | None = None
) -> DataFrame:
    """Core metrics of the validation and, if given, the test predictions."""
    score = F.lit(None).cast("double") if cv_best is None else F.lit(round(float(cv_best), 6))
    out = core_metrics(val).select(F.lit("val").alias("set"), "*", score.alias("cv_best"))
    if test is not None:
        none = F.lit(None).cast("double").alias("cv_best")
        out = out.unionByName(core_metrics(test).select(F.lit("test").alias("set"), "*", none))
    return out
