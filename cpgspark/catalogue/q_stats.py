"""Queries: differential methylation and probe selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cpgspark.catalogue import fixtures as fx
from cpgspark.catalogue.registry import query, rounded
from cpgspark.operators import dm, qc, vectors

_STATS = f"""{fx.LM},
s AS (SELECT probe_id, class, count(value) AS n, avg(value) AS mu,
             var_pop(value) * count(value) AS m2 FROM lm GROUP BY 1, 2),
o AS (SELECT a.probe_id, a.class, a.n, a.mu, a.m2, sum(b.n) AS nr, sum(b.n * b.mu) / sum(b.n) AS mur
      FROM s a JOIN s b ON b.probe_id = a.probe_id AND b.class <> a.class GROUP BY ALL),
r AS (SELECT o.*, (SELECT sum(b.m2 + b.n * pow(b.mu - o.mur, 2)) FROM s b
                   WHERE b.probe_id = o.probe_id AND b.class <> o.class) AS m2r FROM o),
v AS (SELECT *, m2 / (n - 1) AS vc, m2r / (nr - 1) AS vr FROM r),
st AS (SELECT probe_id, class, n, CAST(nr AS BIGINT) AS nr, mu, mur, m2, m2r,
              (mu - mur) / sqrt(vc / n + vr / nr) AS t,
              pow(vc / n + vr / nr, 2) / (pow(vc / n, 2) / (n - 1) + pow(vr / nr, 2) / (nr - 1)) AS df,
              CASE WHEN vc + vr = 0 THEN 0 ELSE (mu - mur) / sqrt((vc + vr) / 2) END AS d
       FROM v)"""

# Two-sided p of t by the continued fraction of the incomplete beta function.
_T_TAIL = """
px AS (SELECT probe_id, class, df / 2 AS a, 0.5e0 AS b, df / (df + t * t) AS x FROM {src}),
pz AS (SELECT probe_id, class, x > (a + 1) / (a + b + 2) AS sw,
              CASE WHEN x > (a + 1) / (a + b + 2) THEN b ELSE a END AS p,
              CASE WHEN x > (a + 1) / (a + b + 2) THEN a ELSE b END AS q,
              CASE WHEN x > (a + 1) / (a + b + 2) THEN 1 - x ELSE x END AS z FROM px),
cf(probe_id, class, p, q, z, k, d, c, h) AS (
  SELECT probe_id, class, p, q, z, 1, 1 / (1 - (p + q) * z / (p + 1)), 1e0,
         1 / (1 - (p + q) * z / (p + 1)) FROM pz
  UNION ALL
  SELECT probe_id, class, p, q, z, k + 1, d2, c2, h1 * d2 * c2 FROM (
    SELECT *, 1 / (1 + e2 * d1) AS d2, 1 + e2 / c1 AS c2, h * d1 * c1 AS h1 FROM (
      SELECT *, 1 / (1 + e1 * d) AS d1, 1 + e1 / c AS c1,
             -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1)) AS e2 FROM (
        SELECT *, k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k)) AS e1 FROM cf WHERE k <= 100)))),
tail AS (SELECT z.probe_id, z.class,
                CASE WHEN z.z = 0 THEN CASE WHEN sw THEN 1e0 ELSE 0e0 END
                     WHEN sw THEN 1 - front * h / z.p ELSE front * h / z.p END AS pv
         FROM (SELECT *, CASE WHEN z > 0 THEN exp(lgamma(p + q) - lgamma(p) - lgamma(q)
                                + p * ln(z) + q * ln(1 - z)) END AS front FROM pz) z
         JOIN cf ON cf.probe_id = z.probe_id AND cf.class = z.class AND cf.k = 101)"""
_P = f"{_STATS}, {_T_TAIL.format(src='st')}"
_BEST = f"""{_P},
ranked AS (SELECT t.probe_id, t.class, t.pv, st.d, count(*) OVER w AS n,
                  row_number() OVER (PARTITION BY t.probe_id ORDER BY t.pv) AS r
           FROM tail t JOIN st ON st.probe_id = t.probe_id AND st.class = t.class
           WINDOW w AS (PARTITION BY t.probe_id)),
qv AS (SELECT *, least(1e0, min(pv * n / r) OVER (PARTITION BY probe_id ORDER BY r
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ranked),
best AS (SELECT probe_id, arg_min({{c: class, p: pv, q: q, d: d}}, (q, class)) AS b
         FROM qv GROUP BY probe_id)"""


@query(
    "dm_class_stats",
    f"""WITH {_STATS} SELECT probe_id, class, n AS n_class, nr AS n_rest,
    round(mu, 6) + 0.0 AS mean_class, round(mur, 6) + 0.0 AS mean_rest, round(t, 6) + 0.0 AS t,
    round(df, 4) + 0.0 AS df, round(d, 6) + 0.0 AS effect_size FROM st""",
)
def dm_class_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = dm.dm_class_stats(fx.labelled(spark, sf))
    for name in ("mean_class", "mean_rest", "t", "effect_size"):
        out = out.withColumn(name, rounded(name))
    return out.withColumn("df", rounded("df", 4))


@query(
    "welch_p",
    f"WITH RECURSIVE {_P} SELECT probe_id, class, round(pv, 6) + 0.0 AS p_value FROM tail",
)
def welch_p(spark: SparkSession, sf: str) -> DataFrame:
    out = dm.welch_p(dm.dm_class_stats(fx.labelled(spark, sf)))
    return out.select("probe_id", "class", rounded("p_value").alias("p_value"))


@query(
    "bh_fdr",
    f"WITH RECURSIVE {_BEST} SELECT probe_id, class, round(q, 6) + 0.0 AS q_value FROM qv",
)
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    stats = dm.welch_p(dm.dm_class_stats(fx.labelled(spark, sf)))
    out = dm.bh_fdr(stats, ["probe_id"])
    return out.select("probe_id", "class", rounded("q_value").alias("q_value"))


def _p_like(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in [0, 1) that serve as p-values."""
    p = (F.col("o_totalprice") % 1000) / 1000
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", p.alias("p_value")
    )


def _large_sql(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""WITH s AS (SELECT o_orderkey, o_orderpriority, o_orderstatus,
                         (o_totalprice % 1000) / 1000 AS p FROM orders),
    r AS (SELECT *, count(*) OVER ({part}) AS n, row_number() OVER ({part} ORDER BY p) AS r FROM s)
    SELECT o_orderkey, round(least(1e0, min(p * n / r) OVER ({part} ORDER BY r
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS q_value FROM r"""


@query("bh_fdr_all", _large_sql(""))
def bh_fdr_all(spark: SparkSession, sf: str) -> DataFrame:
    out = dm.bh_fdr_large(_p_like(spark, sf))
    return out.select("o_orderkey", rounded("q_value").alias("q_value"))


@query("bh_fdr_groups", _large_sql("o_orderpriority, o_orderstatus"))
def bh_fdr_groups(spark: SparkSession, sf: str) -> DataFrame:
    out = dm.bh_fdr_large(_p_like(spark, sf), ["o_orderpriority", "o_orderstatus"])
    return out.select("o_orderkey", rounded("q_value").alias("q_value"))


@query(
    "dm_best_class",
    f"""WITH RECURSIVE {_BEST} SELECT probe_id, b.c AS best_class, round(b.p, 6) + 0.0 AS best_p,
    round(b.q, 6) + 0.0 AS best_q, round(b.d, 6) + 0.0 AS best_effect_size FROM best""",
)
def dm_best_class(spark: SparkSession, sf: str) -> DataFrame:
    summary, _ = dm.differential_methylation(fx.labelled(spark, sf))
    return summary.select(
        "probe_id",
        "best_class",
        *[rounded(c).alias(c) for c in ("best_p", "best_q", "best_effect_size")],
    )


@query(
    "dm_select",
    f"""WITH RECURSIVE {_BEST} SELECT probe_id, b.c AS best_class, round(b.q, 6) + 0.0 AS best_q,
    round(b.d, 6) + 0.0 AS best_effect_size FROM best WHERE b.q <= 0.05 AND abs(b.d) >= 0.3""",
)
def dm_select(spark: SparkSession, sf: str) -> DataFrame:
    _, selected = dm.differential_methylation(fx.labelled(spark, sf))
    return selected.select(
        "probe_id",
        "best_class",
        *[rounded(c).alias(c) for c in ("best_q", "best_effect_size")],
    )


@query("moderated_stats")
def moderated_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = qc.drop_nonfinite_probes(fx.measurements(spark, sf))
    return dm.moderated_stats(rows.join(fx.labels(spark, sf), "sample_id"), robust=False)


@query("moderated_stats_robust")
def moderated_stats_robust(spark: SparkSession, sf: str) -> DataFrame:
    rows = qc.drop_nonfinite_probes(fx.measurements(spark, sf))
    return dm.moderated_stats(rows.join(fx.labels(spark, sf), "sample_id"), robust=True)


@query("moderated_dm")
def moderated_dm(spark: SparkSession, sf: str) -> DataFrame:
    rows = qc.drop_nonfinite_probes(fx.measurements(spark, sf))
    return dm.moderated_dm(rows.join(fx.labels(spark, sf), "sample_id"))


_ANOVA = """
a AS (SELECT probe_id, class, count({v}) AS n, avg({v}) AS mu, var_pop({v}) * count({v}) AS m2
      FROM lm GROUP BY 1, 2),
g AS (SELECT probe_id, sum(n) AS n, sum(n * mu) / sum(n) AS mu, count(*) AS k, sum(m2) AS w
      FROM a GROUP BY 1),
f AS (SELECT g.probe_id, CAST(g.k - 1 AS BIGINT) AS df_between, CAST(g.n - g.k AS BIGINT) AS df_within,
             (SELECT sum(a.n * pow(a.mu - g.mu, 2)) FROM a WHERE a.probe_id = g.probe_id) / (g.k - 1)
             / (g.w / (g.n - g.k)) AS f_score FROM g)"""


def _f_columns(out: DataFrame) -> DataFrame:
    return out.withColumn("f_score", rounded("f_score"))


@query(
    "anova_f",
    f"""WITH {fx.LM}, {_ANOVA.format(v="value")} SELECT probe_id, round(f_score, 6) + 0.0 AS f_score,
    df_between, df_within FROM f""",
)
def anova_f(spark: SparkSession, sf: str) -> DataFrame:
    return _f_columns(dm.anova_f(fx.labelled(spark, sf)))


@query(
    "select_k_best",
    f"""WITH {fx.LM}, {_ANOVA.format(v="coalesce(value, 0)")}
    SELECT probe_id, round(f_score, 6) + 0.0 AS f_score, df_between, df_within FROM f
    ORDER BY f.f_score DESC, probe_id LIMIT 20""",
)
def select_k_best(spark: SparkSession, sf: str) -> DataFrame:
    # Rows of missing cells are left out here: absent must count as zero too.
    known = fx.labelled(spark, sf).filter(F.col("value").isNotNull())
    return _f_columns(dm.select_k_best(dm.anova_f(known, zero_fill=True), 20))


@query(
    "precomputed_select",
    """WITH st AS (SELECT CAST(p_partkey AS VARCHAR) AS probe_id, (p_retailprice % 100) / 100 AS p FROM part),
    top AS (SELECT * FROM st ORDER BY p, probe_id LIMIT 500),
    sel AS (SELECT CAST(p_partkey AS VARCHAR) AS probe_id FROM part WHERE p_size <= 25),
    k AS (SELECT probe_id, p FROM top WHERE probe_id IN (SELECT probe_id FROM sel)
          AND probe_id IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'A'))
    SELECT probe_id, CAST(row_number() OVER (ORDER BY p, probe_id) AS INTEGER) AS place FROM k""",
)
def precomputed_select(spark: SparkSession, sf: str) -> DataFrame:
    part = fx.table(spark, sf, "part")
    stats = part.select(
        fx.text("p_partkey").alias("feature"), ((F.col("p_retailprice") % 100) / 100).alias("pval")
    )
    chosen = part.filter("p_size <= 25").select(fx.text("p_partkey").alias("feature"))
    present = (
        fx.table(spark, sf, "lineitem")
        .filter("l_returnflag = 'A'")
        .select(fx.text("l_partkey").alias("probe_id"))
    )
    return dm.precomputed_select(stats, chosen, present, 500)


@query(
    "standard_scale",
    f"""WITH {fx.M}, s AS (SELECT probe_id, avg(value) AS mu, stddev_pop(value) AS sd FROM m GROUP BY 1)
    SELECT m.sample_id, m.probe_id, round((value - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) + 0.0 AS value
    FROM m JOIN s ON s.probe_id = m.probe_id""",
)
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    out = vectors.standard_scale(fx.measurements(spark, sf))
    return out.select("sample_id", "probe_id", rounded("value").alias("value"))


@query(
    "class_weights",
    f"""WITH {fx.LAB} SELECT sample_id, class, round(count(*) OVER () * 1e0
      / ((SELECT count(DISTINCT class) FROM lab) * count(*) OVER (PARTITION BY class)), 6) + 0.0 AS weight
    FROM lab""",
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    out = vectors.class_weights(fx.labels(spark, sf))
    return out.select("sample_id", "class", rounded("weight").alias("weight"))
