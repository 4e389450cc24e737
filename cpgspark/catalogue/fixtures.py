"""Domain views over the given tables, in Spark and as SQL for the comparison.

Each Spark function has a SQL twin of the same rows: the constants in capitals are
lists of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cpgspark.operators.harmonise import BEST_TEXT, SUPERIOR_TEXT, probe_map
from cpgspark.operators.tree import ROOT, build_tree
from cpgspark.plans.durable import store


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(column: str):
    return F.col(column).cast("string")


# --- measurements and labels from `embeddings` -----------------------------------


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """One probe per vector position; every fourth probe has gaps."""
    cells = table(spark, sf, "embeddings").select(
        text("vec_id").alias("sample_id"), F.posexplode("embedding").alias("i", "v")
    )
    gap = (F.col("i") % 4 == 0) & F.md5(
        F.concat("sample_id", F.lit(":"), text("i"))
    ).startswith("0")
    return cells.select(
        "sample_id",
        F.concat(F.lit("p"), F.lpad(text("i"), 2, "0")).alias("probe_id"),
        F.when(~gap, F.col("v").cast("double")).alias("value"),
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        text("vec_id").alias("sample_id"), F.concat(F.lit("c"), text("label")).alias("class")
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return measurements(spark, sf).join(labels(spark, sf), "sample_id")


M = """
m AS (
  SELECT sample_id, 'p' || lpad(CAST(i AS VARCHAR), 2, '0') AS probe_id,
         CASE WHEN i % 4 = 0 AND substr(md5(sample_id || ':' || CAST(i AS VARCHAR)), 1, 1) = '0'
              THEN NULL ELSE CAST(v AS DOUBLE) END AS value
  FROM (SELECT CAST(vec_id AS VARCHAR) AS sample_id, unnest(embedding) AS v,
               unnest(range(0, len(embedding))) AS i FROM embeddings)
)"""
LAB = """
lab AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, 'c' || CAST(label AS VARCHAR) AS class
        FROM embeddings)"""
LM = M + "," + LAB + """,
lm AS (SELECT m.*, lab.class FROM m JOIN lab ON lab.sample_id = m.sample_id)"""

PROBES = [f"p{i:02d}" for i in range(64)]


# --- quality-control views from `lineitem` and `part` ------------------------------


def qc_measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Stored, as measurements are: the filters pass over them several times."""
    known = F.when(F.col("l_discount") > 0, F.col("l_extendedprice"))
    best = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.max(known).alias("value"))
    )
    rows = best.select(
        text("l_suppkey").alias("sample_id"), text("l_partkey").alias("probe_id"), "value"
    )
    return store(rows, "qc")


def probe_metadata(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    chrom = (
        F.when(size == 1, "chrX").when(size == 2, "chrY").when(size == 3, "chrM")
        .otherwise(F.concat(F.lit("chr"), text("p_size")))
    )
    return table(spark, sf, "part").select(
        text("p_partkey").alias("probe_id"),
        F.when(size % 7 != 0, F.col("p_brand")).alias("gencodebasic_name"),
        chrom.alias("chr_hg38"),
    )


def problem_probes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")

    def listed(step: int, reason: str) -> DataFrame:
        return part.filter(F.col("p_size") % step == 0).select(
            text("p_partkey").alias("probe_id"), F.lit(reason).alias("reason")
        )

    return listed(11, "Polymorphism").unionByName(listed(13, "CrossHybridization"))


QC = """
q AS (SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, CAST(l_partkey AS VARCHAR) AS probe_id,
             max(CASE WHEN l_discount > 0 THEN l_extendedprice END) AS value
      FROM lineitem GROUP BY 1, 2),
meta AS (SELECT CAST(p_partkey AS VARCHAR) AS probe_id,
                CASE WHEN p_size % 7 <> 0 THEN p_brand END AS gencodebasic_name,
                CASE p_size WHEN 1 THEN 'chrX' WHEN 2 THEN 'chrY' WHEN 3 THEN 'chrM'
                     ELSE 'chr' || CAST(p_size AS VARCHAR) END AS chr_hg38 FROM part),
problems AS (SELECT CAST(p_partkey AS VARCHAR) AS probe_id, 'Polymorphism' AS reason
             FROM part WHERE p_size % 11 = 0
             UNION ALL
             SELECT CAST(p_partkey AS VARCHAR), 'CrossHybridization' FROM part WHERE p_size % 13 = 0)"""


# --- array reports and manifest from `lineitem` --------------------------------------

_ILMN = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _probe_name():
    return F.concat_ws("-", *[text(c) for c in _ILMN])


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    verdict = (
        F.when(flag == "A", SUPERIOR_TEXT)
        .when(flag == "R", BEST_TEXT + " precision by group mean")
        .otherwise("Inferior probe")
    )
    return table(spark, sf, "lineitem").select(
        _probe_name().alias("IlmnID"),
        text("l_partkey").alias("Name"),
        text("l_orderkey").alias("EPICv1locmatch"),
        verdict.alias("Rep_results_by_NAME"),
    )


def stored_probe_map(spark: SparkSession, sf: str) -> DataFrame:
    """The probe map is made once per manifest and then reused."""
    return store(probe_map(manifest(spark, sf)), "probe-map")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), text_of(F.col("l_suppkey") % 5)).alias("meth_sample_id"),
        _probe_name().alias("Name"),
        text("l_orderkey").alias("EPICv1_Loci"),
        F.col("l_extendedprice").alias("MValue"),
        F.col("l_discount").alias("Beta"),
    )


def text_of(column):
    return column.cast("string")


REPORTS = """
reports AS (SELECT 'S' || CAST(l_suppkey % 5 AS VARCHAR) AS meth_sample_id,
                   concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS name,
                   CAST(l_orderkey AS VARCHAR) AS locus, l_extendedprice AS mvalue,
                   l_discount AS beta FROM lineitem)"""
MANIFEST = """
manifest AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS ilmn,
                    CAST(l_partkey AS VARCHAR) AS name, CAST(l_orderkey AS VARCHAR) AS locus,
                    CASE l_returnflag WHEN 'A' THEN 'Superior probe'
                         WHEN 'R' THEN 'Best precision by group mean'
                         ELSE 'Inferior probe' END AS result FROM lineitem),
listed AS (SELECT locus, max(CAST(result = 'Superior probe' AS INTEGER)) AS sup,
                  max(CAST(contains(result, 'Best') AS INTEGER)) AS best
           FROM manifest GROUP BY locus HAVING count(*) IN (2, 3, 4, 5, 6, 10)),
chosen AS (SELECT m.locus, m.ilmn FROM manifest m JOIN listed l ON l.locus = m.locus
           WHERE (sup = 1 AND result = 'Superior probe')
              OR (sup = 0 AND contains(result, 'Best')))"""


# --- trees -------------------------------------------------------------------------------


def edges(spark: SparkSession, sf: str) -> DataFrame:
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    top = region.select(F.lit(ROOT).alias("parent"), F.col("r_name").alias("child"))
    low = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("parent"), F.col("n_name").alias("child")
    )
    return top.unionByName(low)


def disease_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Customers at their nation; those of one market segment at the region."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(F.col("c_mktsegment") == "BUILDING", F.col("r_name")).otherwise(F.col("n_name"))
    return (
        table(spark, sf, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(text("c_custkey").alias("sample_id"), name.alias("diseaseName"))
    )


def disease_tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return build_tree(edges(spark, sf), disease_samples(spark, sf))


def class_tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Groups of classes over the labelled vectors: ROOT, g0..g2, c0..c9."""
    vectors = table(spark, sf, "embeddings")
    group = F.concat(F.lit("g"), text_of(F.col("label") % 3))
    cls = F.concat(F.lit("c"), text("label"))
    top = vectors.select(F.lit(ROOT).alias("parent"), group.alias("child")).distinct()
    low = vectors.select(group.alias("parent"), cls.alias("child")).distinct()
    samples = vectors.select(text("vec_id").alias("sample_id"), cls.alias("diseaseName"))
    return build_tree(top.unionByName(low), samples)


_WALK = """
walk(name, path, parent, level) AS (
  SELECT 'ROOT', 'ROOT', CAST(NULL AS VARCHAR), 1
  UNION ALL
  SELECT e.child, w.path || '/' || e.child, w.path, w.level + 1
  FROM walk w JOIN edges e ON e.parent = w.name),
ts AS (SELECT w.path, w.name, w.level, s.sample_id FROM dsamples s JOIN walk w ON w.name = s.disease),
occ AS (SELECT DISTINCT path FROM ts),
nodes AS (SELECT * FROM walk w WHERE level = 1 OR EXISTS (
            SELECT 1 FROM occ WHERE occ.path = w.path OR starts_with(occ.path, w.path || '/'))),
closure AS (SELECT n.path, n.name, n.level, n.parent, ts.path AS sample_path, ts.sample_id
            FROM nodes n JOIN ts ON ts.path = n.path OR starts_with(ts.path, n.path || '/'))"""
TREE = """
edges AS (SELECT 'ROOT' AS parent, r_name AS child FROM region
          UNION ALL
          SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
dsamples AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id,
                    CASE WHEN c_mktsegment = 'BUILDING' THEN r_name ELSE n_name END AS disease
             FROM customer JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey),""" + _WALK
CLASS_TREE = """
edges AS (SELECT DISTINCT 'ROOT' AS parent, 'g' || CAST(label % 3 AS VARCHAR) AS child
          FROM embeddings
          UNION ALL
          SELECT DISTINCT 'g' || CAST(label % 3 AS VARCHAR), 'c' || CAST(label AS VARCHAR)
          FROM embeddings),
dsamples AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, 'c' || CAST(label AS VARCHAR) AS disease
             FROM embeddings),""" + _WALK


# --- predictions and scores -----------------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Right on three of four orders, else the class after the true one."""
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    place = F.array_position(names, F.col("o_orderpriority"))
    wrong = F.get(names, F.pmod(place, F.lit(len(PRIORITIES))).cast("int"))
    right = F.col("o_orderkey") % 4 != 0
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.col("o_orderpriority").alias("actual"),
        F.when(right, F.col("o_orderpriority")).otherwise(wrong).alias("predicted"),
        ((F.col("o_orderkey") % 97) / F.lit(100.0)).alias("probability"),
    )


PRED = """
pred AS (SELECT o_orderkey, o_orderpriority AS actual,
                CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority
                     ELSE CASE o_orderpriority WHEN '1-URGENT' THEN '2-HIGH'
                          WHEN '2-HIGH' THEN '3-MEDIUM' WHEN '3-MEDIUM' THEN '4-NOT SPECIFIED'
                          WHEN '4-NOT SPECIFIED' THEN '5-LOW' ELSE '1-URGENT' END END AS predicted,
                (o_orderkey % 97) / 100e0 AS probability FROM orders),
cc AS (SELECT class, sum(tp) AS tp, sum(support) AS support, sum(called) AS called FROM (
         SELECT actual AS class, CAST(actual = predicted AS INTEGER) AS tp, 1 AS support, 0 AS called
         FROM pred
         UNION ALL SELECT predicted, 0, 0, 1 FROM pred) GROUP BY class)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two one-against-rest tasks, quality and toxic, scored by text length."""
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    tasks = F.array(
        F.struct(F.lit("quality").alias("class"), F.col("quality").alias("truth")),
        F.struct(F.lit("toxic").alias("class"), F.col("toxic").alias("truth")),
    )
    score = F.least(F.col("n_chars") / F.lit(4000.0), F.lit(1.0))
    return (
        marks.join(docs.select("doc_id", "n_chars"), "doc_id")
        .select("doc_id", score.alias("score"), F.explode(tasks).alias("t"))
        .select("doc_id", "score", "t.class", "t.truth")
    )


SCORES = """
scored AS (SELECT d.doc_id, least(n_chars / 4000e0, 1e0) AS score, 'quality' AS class,
                  quality AS truth FROM labels l JOIN documents d ON d.doc_id = l.doc_id
           UNION ALL
           SELECT d.doc_id, least(n_chars / 4000e0, 1e0), 'toxic', toxic
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
pts AS (SELECT class, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM scored GROUP BY 1, 2),
cum AS (SELECT class, score,
               sum(pos) OVER (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(neg) OVER (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
               sum(pos) OVER (PARTITION BY class) AS p, sum(neg) OVER (PARTITION BY class) AS n
        FROM pts)"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Walk of every customer down the tree, as step predictions."""
    ts = disease_tree(spark, sf)[1]
    return (
        ts.select(
            "sample_id",
            F.col("node_path").alias("p"),
            F.explode(F.sequence(F.lit(1), F.size("node_path") - 1)).alias("depth"),
        )
        .select(
            "sample_id",
            "depth",
            F.get("p", F.col("depth") - 1).alias("model_name"),
            F.get("p", F.col("depth")).alias("prediction"),
            ((F.col("sample_id").cast("long") % 89) / F.lit(100.0)).alias("probability"),
        )
    )


STEPS = TREE + """,
steps AS (SELECT ts.sample_id, w.level - 1 AS depth, split_part(w.path, '/', w.level - 1) AS model_name,
                 w.name AS prediction, (CAST(ts.sample_id AS BIGINT) % 89) / 100e0 AS probability
          FROM ts JOIN walk w ON w.level > 1
           AND (ts.path = w.path OR starts_with(ts.path, w.path || '/')))"""


def embedding(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    axes = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")]
    return e.select(*axes, text("vec_id").alias("sample_id"))


def sample_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Identifier table of the customers."""
    key = F.lpad(text("c_custkey"), 6, "0")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("P"), key, F.lit("_T_W")).alias("sample_id"),
        F.concat(F.lit("P"), key).alias("patient_id"),
        F.concat(F.lit("P"), key, F.lit("_T_M")).alias("meth_sample_id"),
    )


SAMPLE_IDS = """
sids AS (SELECT 'P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '_T_W' AS sample_id,
                'P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS patient_id,
                'P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '_T_M' AS meth_sample_id
         FROM customer)"""


# --- extracted and loaded samples from `events` -----------------------------------------------


def event_values(spark: SparkSession, sf: str) -> DataFrame:
    """Sample = user and day block, probe = event type; with the first day seen."""
    e = table(spark, sf, "events")
    return e.groupBy(
        F.concat_ws("-", text("user_id"), text_of(F.dayofmonth("ts"))).alias("sample_id"),
        F.concat_ws("-", text("user_id"), text_of(F.dayofmonth("ts")), F.lit("M")).alias(
            "meth_sample_id"
        ),
        F.dayofmonth("ts").alias("day"),
        F.col("event_type").alias("probe_id"),
    ).agg(F.max("value").alias("value"))


EVENTS = """
ev AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(day(ts) AS VARCHAR) AS sample_id,
              CAST(user_id AS VARCHAR) || '-' || CAST(day(ts) AS VARCHAR) || '-M' AS meth_sample_id,
              CAST(day(ts) AS INTEGER) AS day, event_type AS probe_id, max(value) AS value
       FROM events GROUP BY 1, 2, 3, 4)"""
