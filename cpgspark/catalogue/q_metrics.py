"""Queries: evaluation tables, cohort views, imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cpgspark.catalogue import fixtures as fx
from cpgspark.catalogue.registry import query, rounded
from cpgspark.operators import cohort, isotonic, metrics, predict, qc, train, tree

_CORE = """SELECT round(sum(tp) * 1e0 / sum(support), 6) AS accuracy,
  round(avg(CASE WHEN support + called > 0 THEN 2e0 * tp / (support + called) ELSE 0 END), 6) AS f1_macro,
  round(avg(CASE WHEN support > 0 THEN tp * 1e0 / support END), 6) AS balanced_accuracy FROM cc"""


@query("core_metrics", f"WITH {fx.PRED} {_CORE}")
def core_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.core_metrics(fx.predictions(spark, sf))


_GRID = """cls AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS c),
cells AS (SELECT a.c AS actual, b.c AS predicted,
                 (SELECT count(*) FROM pred WHERE pred.actual = a.c AND pred.predicted = b.c) AS n
          FROM cls a CROSS JOIN cls b)"""


@query(
    "confusion_matrix",
    f"""WITH {fx.PRED}, {_GRID} SELECT actual, predicted, n,
    round(n * 1e0 / greatest(sum(n) OVER (PARTITION BY actual), 1), 6) + 0.0 AS share FROM cells""",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.confusion_matrix(fx.predictions(spark, sf), fx.PRIORITIES)
    return out.withColumn("share", rounded("share"))


_REPORT = f"""WITH {fx.PRED},
pc AS (SELECT class, CASE WHEN called > 0 THEN tp * 1e0 / called ELSE 0 END AS p,
              CASE WHEN support > 0 THEN tp * 1e0 / support ELSE 0 END AS r,
              CASE WHEN support + called > 0 THEN 2e0 * tp / (support + called) ELSE 0 END AS f,
              CAST(support AS BIGINT) AS support, tp FROM cc),
rep AS (SELECT class, p, r, f, support FROM pc
  UNION ALL SELECT 'accuracy', sum(tp) * 1e0 / sum(support), sum(tp) * 1e0 / sum(support),
                   sum(tp) * 1e0 / sum(support), CAST(sum(support) AS BIGINT) FROM pc
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM pc
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                   sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pc)
SELECT class, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall,
       round(f, 6) + 0.0 AS f1_score, support FROM rep"""


@query("class_report", _REPORT)
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.class_report(fx.predictions(spark, sf))
    return out.select(
        "class", *[rounded(c).alias(c) for c in ("precision", "recall", "f1_score")], "support"
    )


@query(
    "class_youden",
    f"""WITH {fx.PRED}, t AS (SELECT *, sum(support) OVER () AS total FROM cc),
    y AS (SELECT class, tp * 1e0 / support AS se,
                 (total - support - called + tp) * 1e0 / (total - support) AS sp FROM t WHERE support > 0)
    SELECT class, round(se, 6) + 0.0 AS sensitivity, round(sp, 6) + 0.0 AS specificity,
           round(se + sp - 1, 6) + 0.0 AS youden_index, round(se, 6) + 0.0 AS balanced_accuracy FROM y""",
)
def class_youden(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.class_youden(fx.predictions(spark, sf))
    names = ("sensitivity", "specificity", "youden_index", "balanced_accuracy")
    return out.select("class", *[rounded(c).alias(c) for c in names])


@query(
    "roc_curve",
    f"""WITH {fx.SCORES}, pts2 AS (
      SELECT class, score AS threshold, fp * 1e0 / n AS fpr, tp * 1e0 / p AS tpr FROM cum WHERE p > 0 AND n > 0
      UNION ALL SELECT DISTINCT class, CAST('Infinity' AS DOUBLE), 0e0, 0e0 FROM cum WHERE p > 0 AND n > 0)
    SELECT class, CASE WHEN isinf(threshold) THEN NULL ELSE threshold END AS threshold,
           round(fpr, 6) + 0.0 AS fpr, round(tpr, 6) + 0.0 AS tpr FROM pts2""",
)
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.roc_curve(fx.scores(spark, sf))
    threshold = F.when(F.col("threshold") != float("inf"), F.col("threshold"))
    return out.select(
        "class", threshold.alias("threshold"), rounded("fpr").alias("fpr"), rounded("tpr").alias("tpr")
    )


@query(
    "roc_auc",
    f"""WITH {fx.SCORES}, c2 AS (SELECT class, score, fp * 1e0 / n AS x, tp * 1e0 / p AS y FROM cum
      WHERE p > 0 AND n > 0),
    seg AS (SELECT class, x - lag(x, 1, 0e0) OVER w AS dx, y + lag(y, 1, 0e0) OVER w AS sy FROM c2
            WINDOW w AS (PARTITION BY class ORDER BY score DESC))
    SELECT class, round(sum(dx * sy / 2), 6) + 0.0 AS roc_auc FROM seg GROUP BY class""",
)
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.roc_auc(fx.scores(spark, sf))
    return out.withColumn("roc_auc", rounded("roc_auc"))


@query(
    "pr_curve",
    f"""WITH {fx.SCORES}, pts2 AS (
      SELECT class, score AS threshold, tp * 1e0 / (tp + fp) AS pr, tp * 1e0 / p AS re FROM cum
      WHERE p > 0 AND n > 0
      UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 1e0, 0e0 FROM cum WHERE p > 0 AND n > 0)
    SELECT class, threshold, round(pr, 6) + 0.0 AS precision, round(re, 6) + 0.0 AS recall FROM pts2""",
)
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.pr_curve(fx.scores(spark, sf))
    threshold = F.when(F.col("threshold") != float("inf"), F.col("threshold"))
    return out.select(
        "class",
        threshold.alias("threshold"),
        rounded("precision").alias("precision"),
        rounded("recall").alias("recall"),
    )


@query(
    "brier",
    f"WITH {fx.SCORES} SELECT round(avg(pow(score - truth, 2)), 6) AS brier_score FROM scored",
)
def brier(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.brier(fx.scores(spark, sf)).select(rounded("brier_score").alias("brier_score"))


@query(
    "binary_metrics",
    f"""WITH {fx.SCORES}, a AS (SELECT class, sum((fp - fq) * (tp + tq)) / 2e0 / any_value(p) / any_value(n) AS auc
      FROM (SELECT *, lag(fp, 1, 0) OVER w AS fq, lag(tp, 1, 0) OVER w AS tq FROM cum
            WHERE p > 0 AND n > 0 WINDOW w AS (PARTITION BY class ORDER BY score DESC)) GROUP BY class),
    b AS (SELECT class, avg(CAST(CAST(score >= 0.5 AS INTEGER) = truth AS INTEGER)) AS acc,
                 avg(pow(score - truth, 2)) AS br FROM scored GROUP BY class)
    SELECT b.class, round(acc, 6) + 0.0 AS accuracy, round(br, 6) + 0.0 AS brier_score,
           round(auc, 6) + 0.0 AS roc_auc FROM b LEFT JOIN a ON a.class = b.class""",
)
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.binary_metrics(fx.scores(spark, sf))
    names = ("accuracy", "brier_score", "roc_auc")
    return out.select("class", *[rounded(c).alias(c) for c in names])


@query(
    "share_above",
    "SELECT round(avg(CAST(o_totalprice > 250000 AS INTEGER)), 6) AS share FROM orders",
)
def share_above(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.share_above(fx.table(spark, sf, "orders"), "o_totalprice", 250000.0)
    return out.select(rounded("share").alias("share"))


@query(
    "correct_call_distribution",
    f"""WITH {fx.PRED}, c AS (SELECT predicted AS class, probability AS p,
      CAST(least(floor(probability * 20), 19) AS INTEGER) AS bin FROM pred WHERE actual = predicted),
    b AS (SELECT class, bin, count(*) AS n FROM c GROUP BY 1, 2),
    k AS (SELECT class, count(*) AS total, min(p) AS lo, max(p) AS hi, avg(p) AS mu FROM c GROUP BY 1)
    SELECT b.class, b.bin, b.n, round(b.n * 1e0 / k.total, 6) + 0.0 AS share,
           lo AS min_probability, hi AS max_probability, round(mu, 6) + 0.0 AS mean_probability
    FROM b JOIN k ON k.class = b.class""",
)
def correct_call_distribution(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.correct_call_distribution(qc.correct_calls(fx.predictions(spark, sf)))
    return out.withColumn("share", rounded("share")).withColumn(
        "mean_probability", rounded("mean_probability")
    )


_CORE_OF = """SELECT '{name}' AS set, round(avg(CAST(actual = predicted AS INTEGER)), 6) AS accuracy, (
    SELECT round(avg(f), 6) FROM (SELECT 2e0 * sum(tp) / sum(s) AS f FROM (
      SELECT actual AS class, CAST(actual = predicted AS INTEGER) AS tp, 1 AS s FROM {src}
      UNION ALL SELECT predicted, 0, 1 FROM {src}) GROUP BY class)) AS f1_macro, (
    SELECT round(avg(r), 6) FROM (SELECT avg(CAST(actual = predicted AS INTEGER)) AS r FROM {src}
      GROUP BY actual)) AS balanced_accuracy, {cv} AS cv_best FROM {src}"""


@query(
    "metrics_summary",
    f"""WITH {fx.PRED}, v AS (SELECT pred.* FROM pred JOIN orders o ON o.o_orderkey = pred.o_orderkey WHERE o_orderstatus = 'F'),
    t AS (SELECT pred.* FROM pred JOIN orders o ON o.o_orderkey = pred.o_orderkey WHERE o_orderstatus <> 'F')
    {_CORE_OF.format(name="val", src="v", cv="0.81e0")} UNION ALL
    {_CORE_OF.format(name="test", src="t", cv="CAST(NULL AS DOUBLE)")}""",
)
def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.predictions(spark, sf)
    closed = F.col("o_orderstatus") == "F"
    return metrics.metrics_summary(rows.filter(closed), rows.filter(~closed), 0.81)


@query(
    "isotonic_blocks",
    # The fit at a score: the largest, over starts up to it, of the least mean from there on.
    f"""WITH {fx.SCORES},
    p AS (SELECT class, score, pos, pos + neg AS n, sum(pos) OVER w AS upto, sum(pos + neg) OVER w AS cum_n,
                 row_number() OVER w AS i FROM pts WINDOW w AS (PARTITION BY class ORDER BY score)),
    pairs AS (SELECT a.class, a.i AS a, b.i AS b,
                     (b.upto - a.upto + a.pos) * 1e0 / (b.cum_n - a.cum_n + a.n) AS mean
              FROM p a JOIN p b ON a.class = b.class AND a.i <= b.i),
    least_on AS (SELECT class, a, b, min(mean) OVER (PARTITION BY class, a ORDER BY b DESC) AS m FROM pairs),
    fit AS (SELECT class, b AS i, max(m) AS share FROM least_on GROUP BY 1, 2)
    SELECT p.class, min(score) AS low, max(score) AS high, CAST(sum(pos) AS BIGINT) AS positives,
           CAST(sum(n) AS BIGINT) AS n, round(share, 6) + 0.0 AS probability
    FROM p JOIN fit ON fit.class = p.class AND fit.i = p.i GROUP BY p.class, share""",
)
def isotonic_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.scores(spark, sf)
    made = [
        isotonic.isotonic_blocks(rows.filter(F.col("class") == c)).withColumn("class", F.lit(c))
        for c in ("quality", "toxic")
    ]
    share = rounded(F.col("positives") / F.col("n")).alias("probability")
    return made[0].unionByName(made[1]).select("class", "low", "high", "positives", "n", share)


# --- step predictions -------------------------------------------------------------------


@query(
    "final_prediction",
    f"""WITH RECURSIVE {fx.STEPS} SELECT sample_id, arg_max(prediction, depth) AS final_prediction
    FROM steps GROUP BY sample_id""",
)
def final_prediction(spark: SparkSession, sf: str) -> DataFrame:
    return predict.final_prediction(fx.steps(spark, sf))


@query(
    "predictions_map",
    f"""WITH RECURSIVE {fx.STEPS} SELECT sample_id, string_agg(model_name || '>' || prediction || ':'
    || CAST(CAST(round(probability * 100) AS INTEGER) AS VARCHAR), ';' ORDER BY model_name) AS entries
    FROM steps GROUP BY sample_id""",
)
def predictions_map(spark: SparkSession, sf: str) -> DataFrame:
    """The nested map, read back entry by entry in key order."""
    nested = predict.predictions_map(fx.steps(spark, sf))
    key = F.sort_array(F.map_keys("predictions"))
    shown = F.transform(
        key,
        lambda k: F.concat(
            k,
            F.lit(">"),
            F.col("predictions")[k]["prediction"],
            F.lit(":"),
            F.round(F.col("predictions")[k]["probability"] * 100).cast("int").cast("string"),
        ),
    )
    return nested.select("sample_id", F.array_join(shown, ";").alias("entries"))


@query(
    "predict_binary",
    f"""WITH {fx.SCORES} SELECT doc_id, class, score AS probability,
    CAST(score >= 0.5 AS INTEGER) AS label FROM scored""",
)
def predict_binary(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("score")
    rows = fx.scores(spark, sf).withColumn("scores", F.array(1 - score, score))
    return predict.predict_binary(rows).select("doc_id", "class", "probability", "label")


@query(
    "cv_curve",
    """SELECT p_size AS n_trees, round(avg(p_retailprice / 2000), 6) + 0.0 AS mean_score
       FROM part GROUP BY p_size""",
)
def cv_curve(spark: SparkSession, sf: str) -> DataFrame:
    results = fx.table(spark, sf, "part").select(
        F.col("p_size").alias("n_trees"), (F.col("p_retailprice") / 2000).alias("mean_test_score")
    )
    out = train.cv_curve(results)
    return out.withColumn("mean_score", rounded("mean_score"))


# --- cohort views ---------------------------------------------------------------------------

_EMB = """
emb AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
               CAST(embedding[3] AS DOUBLE) AS z, CAST(vec_id AS VARCHAR) AS sample_id,
               'g' || CAST(label % 3 AS VARCHAR) AS grp FROM embeddings)"""


def _diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    _, held = fx.class_tree(spark, sf)
    samples = fx.labels(spark, sf).select(
        "sample_id", F.concat("sample_id", F.lit("_M")).alias("meth_sample_id")
    )
    return cohort.plot_table(fx.embedding(spark, sf), tree.samples_at_level(held, 2), samples)


@query(
    "plot_table",
    f"""WITH {_EMB} SELECT x, y, z, sample_id, sample_id || '_M' AS meth_sample_id, grp AS "cancerType" FROM emb""",
)
def plot_table(spark: SparkSession, sf: str) -> DataFrame:
    return _diagnosed(spark, sf)


@query(
    "class_centroids",
    f"""WITH {_EMB} SELECT grp AS "cancerType", round(avg(x), 6) + 0.0 AS centroid_x,
    round(avg(y), 6) + 0.0 AS centroid_y, round(max(y) - min(y), 6) + 0.0 AS y_range FROM emb GROUP BY grp""",
)
def class_centroids(spark: SparkSession, sf: str) -> DataFrame:
    out = cohort.class_centroids(_diagnosed(spark, sf))
    names = ("centroid_x", "centroid_y", "y_range")
    return out.select("cancerType", *[rounded(c).alias(c) for c in names])


@query(
    "mean_impute",
    f"""WITH {fx.M} SELECT sample_id, probe_id,
    round(coalesce(value, avg(value) OVER (PARTITION BY probe_id)), 6) + 0.0 AS value FROM m""",
)
def mean_impute(spark: SparkSession, sf: str) -> DataFrame:
    # Missing cells come as absent rows here.
    known = fx.measurements(spark, sf).filter(F.col("value").isNotNull())
    return cohort.mean_impute(known).withColumn("value", rounded("value"))


@query(
    "knn_impute",
    f"""WITH {fx.M}, np AS (SELECT count(DISTINCT probe_id) AS p FROM m),
    gaps AS (SELECT sample_id, probe_id FROM m WHERE value IS NULL),
    dist AS (SELECT a.sample_id AS t, b.sample_id AS d,
                    sqrt((SELECT p FROM np) * 1e0 / count(*) * sum(pow(a.value - b.value, 2))) AS dd
             FROM m a JOIN m b ON b.probe_id = a.probe_id AND b.sample_id <> a.sample_id
             WHERE a.value IS NOT NULL AND b.value IS NOT NULL
               AND a.sample_id IN (SELECT sample_id FROM gaps) GROUP BY 1, 2),
    cand AS (SELECT g.sample_id, g.probe_id, b.value, row_number() OVER (
                 PARTITION BY g.sample_id, g.probe_id ORDER BY dd, d) AS r
             FROM gaps g JOIN dist ON dist.t = g.sample_id
             JOIN m b ON b.sample_id = dist.d AND b.probe_id = g.probe_id AND b.value IS NOT NULL),
    guess AS (SELECT sample_id, probe_id, avg(value) AS v FROM cand WHERE r <= 5 GROUP BY 1, 2)
    SELECT m.sample_id, m.probe_id, round(coalesce(m.value, guess.v), 6) + 0.0 AS value
    FROM m LEFT JOIN guess ON guess.sample_id = m.sample_id AND guess.probe_id = m.probe_id""",
)
def knn_impute(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.measurements(spark, sf)
    out = cohort.knn_impute(m, m.select("sample_id"))
    return out.withColumn("value", rounded("value"))
