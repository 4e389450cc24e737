"""Queries: sources, filters, harmonisation, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cpgspark.catalogue import fixtures as fx
from cpgspark.catalogue.registry import query, rounded
from cpgspark.functions import identifiers as ids
from cpgspark.functions import numeric
from cpgspark.operators import harmonise, ingest, qc, splits
from cpgspark.plans.durable import scratch_path
from cpgspark.sources import sinks, tables, wide_csv
from cpgspark.streaming import ingest_stream

# --- sources and sinks ------------------------------------------------------------


def _wide_file(spark: SparkSession, sf: str) -> str:
    """The measurements as a wide CSV in the shared folder."""
    path = scratch_path(spark, "wide")
    wide = sinks.long_to_wide(fx.measurements(spark, sf), fx.PROBES)
    wide.withColumnRenamed("sample_id", wide_csv.ID_COL).write.option("header", True).csv(path)
    return path


@query("wide_to_long", f"WITH {fx.M} SELECT sample_id, probe_id, value FROM m")
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    return wide_csv.read_wide(spark, _wide_file(spark, sf))


@query("ids_only", "SELECT CAST(vec_id AS VARCHAR) AS biosample_id FROM embeddings")
def ids_only(spark: SparkSession, sf: str) -> DataFrame:
    return wide_csv.read_ids(spark, _wide_file(spark, sf))


_PIVOT = ", ".join(
    f"max(CASE WHEN probe_id = '{p}' THEN value END) AS {p}" for p in fx.PROBES
)


@query("long_to_wide", f"WITH {fx.M} SELECT sample_id, {_PIVOT} FROM m GROUP BY sample_id")
def long_to_wide(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.long_to_wide(fx.measurements(spark, sf), fx.PROBES)


def _report_folder(spark: SparkSession, sf: str) -> str:
    """The reports as one tab-separated folder per sample."""
    path = scratch_path(spark, "reports")
    rows = fx.reports(spark, sf).select(
        "Name",
        "EPICv1_Loci",
        "MValue",
        "Beta",
        F.lit("NA").alias("Manifest_probe_match"),
        F.lit("NA").alias("Start_hg38"),
        F.concat("meth_sample_id", F.lit(ids.REPORT_SUFFIX)).alias("report"),
    )
    rows.write.partitionBy("report").option("sep", "\t").option("header", True).csv(path)
    return path


@query(
    "read_array_report",
    f"""WITH {fx.REPORTS}
    SELECT meth_sample_id, name AS "Name", locus AS "EPICv1_Loci", mvalue AS "MValue",
           beta AS "Beta", CAST(NULL AS VARCHAR) AS "Manifest_probe_match",
           CAST(NULL AS DOUBLE) AS "Start_hg38" FROM reports""",
)
def read_array_report(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_array_report(spark, _report_folder(spark, sf), folders=True)


@query(
    "discover_reports",
    f"WITH {fx.REPORTS} SELECT DISTINCT meth_sample_id FROM reports",
)
def discover_reports(spark: SparkSession, sf: str) -> DataFrame:
    found = tables.discover_reports(spark, _report_folder(spark, sf), folders=True)
    return found.select("meth_sample_id").distinct()


@query(
    "read_manifest",
    f"""WITH {fx.MANIFEST}
    SELECT ilmn AS "IlmnID", name AS "Name", locus AS "EPICv1locmatch",
           CAST(NULL AS VARCHAR) AS "UCSC_RefGene_Name", CAST(NULL AS VARCHAR) AS "GencodeV41_Name",
           result AS "Rep_results_by_NAME", CAST(NULL AS DOUBLE) AS "RMSE_with_WGBS" FROM manifest""",
)
def read_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    na = F.lit("NA")
    fx.manifest(spark, sf).select(
        "IlmnID",
        "Name",
        "EPICv1locmatch",
        na.alias("UCSC_RefGene_Name"),
        na.alias("GencodeV41_Name"),
        "Rep_results_by_NAME",
        na.alias("RMSE_with_WGBS"),
    ).write.option("header", True).csv(path)
    return tables.read_manifest(spark, path)


@query(
    "read_labels",
    f"WITH {fx.LAB} SELECT sample_id AS biosample_id, class AS label FROM lab",
)
def read_labels(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "labels")
    fx.labels(spark, sf).select(
        F.col("sample_id").alias("biosample_id"),
        F.col("class").alias("label"),
        F.lit("disease").alias("disease_status"),
    ).write.option("header", True).csv(path)
    return tables.read_labels(spark, path)


@query(
    "scan_filter_sink",
    f"""WITH {fx.QC}
    SELECT sample_id, probe_id, value FROM q
    WHERE probe_id NOT IN (SELECT probe_id FROM meta WHERE chr_hg38 IN ('chrX', 'chrY', 'chrM'))
      AND probe_id IN (SELECT probe_id FROM meta WHERE gencodebasic_name IS NOT NULL)""",
)
def scan_filter_sink(spark: SparkSession, sf: str) -> DataFrame:
    source, target = scratch_path(spark, "scan"), scratch_path(spark, "sink")
    fx.qc_measurements(spark, sf).write.parquet(source)
    meta = fx.probe_metadata(spark, sf)
    sinks.scan_filter_sink(spark, source, target, qc.gene_probes(meta), qc.xym_probes(meta))
    return spark.read.parquet(target)


_HARMONISED = f"""WITH {fx.REPORTS}, {fx.MANIFEST},
means AS (SELECT r.meth_sample_id, c.locus, avg(r.mvalue) AS mv, avg(r.beta) AS bv
          FROM reports r JOIN chosen c ON c.ilmn = r.name GROUP BY 1, 2),
repl AS (SELECT r.meth_sample_id, r.locus, coalesce(mv, r.mvalue) AS mvalue,
                coalesce(bv, r.beta) AS beta
         FROM reports r LEFT JOIN means m ON m.meth_sample_id = r.meth_sample_id AND m.locus = r.locus),
dm AS (SELECT DISTINCT meth_sample_id, locus, mvalue FROM repl),
db AS (SELECT DISTINCT meth_sample_id, locus, beta FROM repl),
vm AS (SELECT meth_sample_id, locus, max(mvalue) AS value FROM dm GROUP BY 1, 2 HAVING count(*) = 1),
vb AS (SELECT meth_sample_id, locus, max(beta) AS value FROM db GROUP BY 1, 2 HAVING count(*) = 1),
h AS (SELECT 'M' AS kind, * FROM vm UNION ALL SELECT 'Beta', * FROM vb)
"""
_HARMONISED_ROWS = (
    _HARMONISED
    + "SELECT kind, meth_sample_id, locus AS \"probeName\", round(value, 6) + 0.0 AS value FROM h"
)


def _harmonised(spark: SparkSession, sf: str) -> DataFrame:
    mapping = fx.stored_probe_map(spark, sf)
    return harmonise.harmonise(fx.reports(spark, sf), None, mapping)


@query("write_samples", _HARMONISED_ROWS)
def write_samples(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch_path(spark, "samples")
    sinks.write_samples(_harmonised(spark, sf), target)
    stored = spark.read.schema(
        "probeName string, value double, kind string, meth_sample_id string"
    ).parquet(target)
    return stored.withColumn("value", rounded("value"))


_SPLIT_IDS = """
ranked AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS r,
                  count(*) OVER () AS n FROM ids),
asg AS (SELECT id, CASE WHEN r <= greatest(1, floor(n * 0.7e0)) THEN 'train'
                        WHEN r <= greatest(1, floor(n * 0.7e0)) + floor(n * 0.15e0) THEN 'val'
                        ELSE 'test' END AS split FROM ranked)"""


def written_splits(spark: SparkSession, sf: str) -> str:
    """The wide matrix cut into split files; their folder."""
    source, target = _wide_file(spark, sf), scratch_path(spark, "splits")
    found = wide_csv.read_ids(spark, source)
    wide_csv.write_splits(spark, source, target, splits.split_ids(found, wide_csv.ID_COL))
    return target


def split_file_rows(spark: SparkSession, target: str) -> DataFrame:
    """``split, n_rows`` of written split files; only the ids are read."""
    out = None
    for name in ("train", "val", "test"):
        rows = wide_csv.read_ids(spark, f"{target}/split={name}")
        part = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("split"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "written_split_rows",
    f"""WITH ids AS (SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings), {_SPLIT_IDS},
    names AS (SELECT unnest(['train', 'val', 'test']) AS split)
    SELECT split, count(id) AS n_rows FROM names LEFT JOIN asg USING (split) GROUP BY 1""",
)
def written_split_rows(spark: SparkSession, sf: str) -> DataFrame:
    return split_file_rows(spark, written_splits(spark, sf))


@query(
    "write_splits",
    f"""WITH {fx.M}, ids AS (SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings), {_SPLIT_IDS}
    SELECT split, sample_id, probe_id, value FROM m JOIN asg ON asg.id = m.sample_id""",
)
def write_splits(spark: SparkSession, sf: str) -> DataFrame:
    target = written_splits(spark, sf)
    out = None
    for name in ("train", "val", "test"):
        rows = wide_csv.read_wide(spark, f"{target}/split={name}")
        rows = rows.select(F.lit(name).alias("split"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "split_manifest",
    f"""WITH ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents), {_SPLIT_IDS}
    SELECT split, substr(md5(id), 1, 2) AS part, string_agg(id, ',' ORDER BY id) AS ids,
           sum(count(*)) OVER (PARTITION BY split)::BIGINT AS n_ids,
           sum(count(*)) OVER ()::BIGINT AS total, 42 AS seed FROM asg GROUP BY 1, 2""",
)
def split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    parts = splits.split_ids(fx.table(spark, sf, "documents"), "doc_id")
    rows = splits.split_manifest(parts, "doc_id")
    return rows.select("split", "part", F.array_join("ids", ",").alias("ids"), "n_ids", "total", "seed")


@query(
    "manifest_file",
    f"""WITH ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents), {_SPLIT_IDS}
    SELECT id AS sample_id, split, 'documents' AS input_csv, 42 AS seed, 'doc_id' AS id_col,
           count(*) OVER ()::INTEGER AS total,
           (count(*) FILTER (split = 'val') OVER ())::INTEGER AS n_val FROM asg""",
)
def manifest_file(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest written as one JSON document and read back."""
    target = scratch_path(spark, "manifest-file")
    parts = splits.split_ids(fx.table(spark, sf, "documents"), "doc_id")
    sinks.write_manifest(parts, target, "doc_id", "documents")
    settings = sinks.written_settings(spark, target)
    rows = sinks.written_assignments(spark, target)
    return rows.withColumn("doc", settings.select(F.struct("*")).scalar()).select(
        "sample_id", "split", "doc.input_csv", "doc.seed", "doc.id_col",
        F.col("doc.counts.total").alias("total"), F.col("doc.counts.val").alias("n_val"),
    )


@query(
    "manifest_counts",
    f"""WITH ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents), {_SPLIT_IDS}
    SELECT count(*) AS total, count(*) FILTER (split = 'train') AS train,
           count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM asg""",
)
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return splits.manifest_counts(splits.split_ids(fx.table(spark, sf, "documents"), "doc_id"))


@query(
    "lookup_samples",
    f"""WITH {fx.SAMPLE_IDS}
    SELECT sample_id, patient_id, meth_sample_id FROM sids WHERE meth_sample_id IN
      (SELECT 'P' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '_T_M' FROM orders)""",
)
def lookup_samples(spark: SparkSession, sf: str) -> DataFrame:
    key = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    keys = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("P"), key, F.lit("_T_M")).alias("meth_sample_id")
    )
    return ingest.lookup_samples(fx.sample_ids(spark, sf), keys)


@query(
    "convert_ids",
    f"""WITH {fx.SAMPLE_IDS},
    asked AS (SELECT 'P' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '_T_W' AS sample_id
              FROM lineitem)
    SELECT a.sample_id, s.meth_sample_id FROM asked a LEFT JOIN sids s ON s.sample_id = a.sample_id""",
)
def convert_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.lpad(F.col("l_suppkey").cast("string"), 6, "0")
    asked = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), key, F.lit("_T_W")).alias("sample_id")
    )
    return ingest.convert_ids(fx.sample_ids(spark, sf), asked, "sample_id", "meth_sample_id")


# --- filters ---------------------------------------------------------------------------


def _qc(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        fx.qc_measurements(spark, sf),
        fx.probe_metadata(spark, sf),
        fx.problem_probes(spark, sf),
    )


_GENE = "SELECT probe_id FROM meta WHERE gencodebasic_name IS NOT NULL"
_XYM = "SELECT probe_id FROM meta WHERE chr_hg38 IN ('chrX', 'chrY', 'chrM')"
_SNP = "SELECT probe_id FROM problems WHERE reason = 'Polymorphism'"
_CROSS = "SELECT probe_id FROM problems WHERE reason = 'CrossHybridization'"
_COLS = "sample_id, probe_id, value"


@query("keep_gene_probes", f"WITH {fx.QC} SELECT {_COLS} FROM q WHERE probe_id IN ({_GENE})")
def keep_gene_probes(spark: SparkSession, sf: str) -> DataFrame:
    m, meta, _ = _qc(spark, sf)
    return qc.keep_gene_probes(m, meta).select("sample_id", "probe_id", "value")


@query("drop_xym_probes", f"WITH {fx.QC} SELECT {_COLS} FROM q WHERE probe_id NOT IN ({_XYM})")
def drop_xym_probes(spark: SparkSession, sf: str) -> DataFrame:
    m, meta, _ = _qc(spark, sf)
    return qc.drop_xym_probes(m, meta).select("sample_id", "probe_id", "value")


@query("drop_snp_probes", f"WITH {fx.QC} SELECT {_COLS} FROM q WHERE probe_id NOT IN ({_SNP})")
def drop_snp_probes(spark: SparkSession, sf: str) -> DataFrame:
    m, _, problems = _qc(spark, sf)
    return qc.drop_snp_probes(m, problems).select("sample_id", "probe_id", "value")


@query("drop_cross_hybrid", f"WITH {fx.QC} SELECT {_COLS} FROM q WHERE probe_id NOT IN ({_CROSS})")
def drop_cross_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    m, _, problems = _qc(spark, sf)
    return qc.drop_cross_hybrid(m, problems).select("sample_id", "probe_id", "value")


def _typical_gap(m: DataFrame) -> int:
    """Mean number of missing probes per sample: a limit that parts the samples."""
    row = m.agg(
        F.countDistinct("probe_id").alias("probes"),
        F.countDistinct("sample_id").alias("samples"),
        F.count("value").alias("known"),
    ).first()
    return row["probes"] - row["known"] // row["samples"]


_SPARSE = """
lim AS (SELECT count(DISTINCT probe_id) - count(value) // count(DISTINCT sample_id) AS k,
               count(DISTINCT probe_id) AS np FROM {src}),
dense AS (SELECT sample_id FROM {src} GROUP BY sample_id
          HAVING (SELECT count(DISTINCT probe_id) FROM {kept}) - count(value) <= (SELECT k FROM lim))"""


@query(
    "drop_sparse_samples",
    f"""WITH {fx.QC}, {_SPARSE.format(src="q", kept="q")}
    SELECT {_COLS} FROM q WHERE sample_id IN (SELECT sample_id FROM dense)""",
)
def drop_sparse_samples(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.qc_measurements(spark, sf)
    return qc.drop_sparse_samples(m, _typical_gap(m)).select("sample_id", "probe_id", "value")


@query(
    "drop_incomplete_probes",
    f"""WITH {fx.M} SELECT {_COLS} FROM m WHERE probe_id IN (
      SELECT probe_id FROM m GROUP BY probe_id
      HAVING count(value) = (SELECT count(DISTINCT sample_id) FROM m))""",
)
def drop_incomplete_probes(spark: SparkSession, sf: str) -> DataFrame:
    return qc.drop_incomplete_probes(fx.measurements(spark, sf)).select(
        "sample_id", "probe_id", "value"
    )


_FILTERED = f"""WITH {fx.QC},
g AS (SELECT * FROM q WHERE probe_id IN ({_GENE})),
x AS (SELECT * FROM g WHERE probe_id NOT IN ({_XYM})),
{_SPARSE.format(src="x", kept="x")},
d AS (SELECT * FROM x WHERE sample_id IN (SELECT sample_id FROM dense)),
s AS (SELECT * FROM d WHERE probe_id NOT IN ({_SNP})),
c AS (SELECT * FROM s WHERE probe_id NOT IN ({_CROSS}))
"""


def _filter_limit(m: DataFrame, meta: DataFrame) -> int:
    return _typical_gap(qc.drop_xym_probes(qc.keep_gene_probes(m, meta), meta))


@query("filter_all", _FILTERED + f"SELECT {_COLS} FROM c")
def filter_all(spark: SparkSession, sf: str) -> DataFrame:
    m, meta, problems = _qc(spark, sf)
    kept = qc.filter_all(m, meta, problems, _filter_limit(m, meta))
    return kept.select("sample_id", "probe_id", "value")


def _report_sql() -> str:
    frames = ["q", "g", "x", "d", "s", "c"]
    sizes = [
        f"SELECT {i} AS k, count(DISTINCT sample_id) AS ns, count(DISTINCT probe_id) AS np FROM {t}"
        for i, t in enumerate(frames)
    ]
    lines = " UNION ALL ".join(
        f"SELECT '{name}' AS step, {i} AS step_no" for i, name in enumerate(qc.STEPS, start=1)
    )
    return (
        _FILTERED
        + f", sizes AS ({' UNION ALL '.join(sizes)}), names AS ({lines}) "
        + """SELECT step, step_no, b.ns AS samples_before, b.np AS probes_before,
        a.ns AS samples_after, a.np AS probes_after, b.ns - a.ns AS samples_removed,
        b.np - a.np AS probes_removed
        FROM names JOIN sizes a ON a.k = step_no JOIN sizes b ON b.k = step_no - 1"""
    )


@query("filter_report", _report_sql())
def filter_report(spark: SparkSession, sf: str) -> DataFrame:
    m, meta, problems = _qc(spark, sf)
    return qc.filter_report(m, meta, problems, _filter_limit(m, meta))


@query(
    "purity_filter",
    """SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_mktsegment AS diseaseName
       FROM customer WHERE (c_acctbal + 1000) / 11000 > 0.3e0""",
)
def purity_filter(spark: SparkSession, sf: str) -> DataFrame:
    customer = fx.table(spark, sf, "customer")
    samples = customer.select(
        fx.text("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("diseaseName")
    )
    purity = customer.select(
        fx.text("c_custkey").alias("biosample_id"),
        ((F.col("c_acctbal") + 1000) / 11000).alias("purity"),
    )
    return qc.purity_filter(samples, purity)


# Text cells with infinities, gaps and words, out of real values.
_MESSY_SQL = """
messy AS (SELECT sample_id, probe_id,
                 CASE abs(CAST(sample_id AS BIGINT)) % 5 WHEN 0 THEN 'inf' WHEN 1 THEN 'n/a'
                      ELSE CAST(value AS VARCHAR) END AS cell,
                 CASE abs(CAST(sample_id AS BIGINT)) % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL
                      ELSE value END AS clean FROM m)"""


def _messy(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("sample_id").cast("long") % 5
    cell = F.when(kind == 0, "inf").when(kind == 1, "n/a").otherwise(fx.text("value"))
    return fx.measurements(spark, sf).withColumn("value", cell)


@query(
    "clean_numeric",
    f"""WITH {fx.M}, {_MESSY_SQL}
    SELECT sample_id, probe_id, round(CAST(CAST(coalesce(clean, 0) AS FLOAT) AS DOUBLE), 6) + 0.0 AS value
    FROM messy""",
)
def clean_numeric(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = qc.clean_values(_messy(spark, sf))
    return cleaned.withColumn("value", rounded(F.col("value").cast("double")))


@query(
    "drop_nonfinite_probes",
    f"""WITH {fx.M}, bad AS (SELECT DISTINCT probe_id FROM m WHERE value IS NULL OR value > 0.42)
    SELECT {_COLS} FROM m WHERE probe_id NOT IN (SELECT probe_id FROM bad)""",
)
def drop_nonfinite_probes(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    m = fx.measurements(spark, sf).withColumn(
        "value", F.when(v > 0.42, F.lit(float("-inf"))).otherwise(v)
    )
    return qc.drop_nonfinite_probes(m).select("sample_id", "probe_id", "value")


@query(
    "correct_calls",
    f"""WITH {fx.PRED} SELECT o_orderkey, actual, predicted,
    greatest(probability, 1 - probability) AS probability FROM pred WHERE actual = predicted""",
)
def correct_calls(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("probability")
    rows = fx.predictions(spark, sf).withColumn("probability", F.array(p, 1 - p))
    return qc.correct_calls(rows).select("o_orderkey", "actual", "predicted", "probability")


# --- harmonisation -------------------------------------------------------------------------


@query(
    "replicate_counts",
    f"""WITH {fx.MANIFEST} SELECT c AS replicates, count(*) AS num_loci
    FROM (SELECT locus, count(*) AS c FROM manifest GROUP BY locus) GROUP BY c""",
)
def replicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return harmonise.replicate_counts(fx.manifest(spark, sf))


@query(
    "probe_map",
    f"""WITH {fx.MANIFEST} SELECT locus AS "EPICv1locmatch",
    string_agg(ilmn, ',' ORDER BY ilmn) AS "IlmnID" FROM chosen GROUP BY locus""",
)
def probe_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = harmonise.probe_map(fx.manifest(spark, sf))
    return rows.select("EPICv1locmatch", F.array_join("IlmnID", ",").alias("IlmnID"))


@query(
    "probe_map_unresolved",
    f"""WITH {fx.MANIFEST} SELECT locus AS "EPICv1locmatch", ilmn AS "IlmnID",
    result AS "Rep_results_by_NAME" FROM manifest
    WHERE locus IN (SELECT locus FROM listed WHERE sup = 0 AND best = 0)""",
)
def probe_map_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    rows = harmonise.probe_map_unresolved(fx.manifest(spark, sf))
    return rows.select("EPICv1locmatch", "IlmnID", "Rep_results_by_NAME")


@query(
    "replace_with_mean",
    _HARMONISED.rsplit("dm AS", 1)[0].rstrip().rstrip(",")
    + """ SELECT meth_sample_id, locus AS "EPICv1_Loci", round(mvalue, 6) + 0.0 AS "MValue",
    count(*) AS n FROM repl GROUP BY 1, 2, 3""",
)
def replace_with_mean(spark: SparkSession, sf: str) -> DataFrame:
    mapping = fx.stored_probe_map(spark, sf)
    rows = harmonise.replace_with_mean(fx.reports(spark, sf), mapping, "MValue")
    return rows.groupBy(
        "meth_sample_id", "EPICv1_Loci", rounded("MValue").alias("MValue")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "resolve_loci",
    f"""WITH {fx.REPORTS}, d AS (SELECT DISTINCT meth_sample_id, locus, beta FROM reports)
    SELECT meth_sample_id, locus AS "EPICv1_Loci", max(beta) AS "Beta" FROM d
    GROUP BY 1, 2 HAVING count(*) = 1""",
)
def resolve_loci(spark: SparkSession, sf: str) -> DataFrame:
    return harmonise.resolve_loci(fx.reports(spark, sf), "Beta")


_V1 = """, h2 AS (SELECT kind, meth_sample_id, locus, value FROM h
  UNION ALL SELECT 'M', 'V1-' || CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_totalprice FROM orders
  UNION ALL SELECT 'Beta', 'V1-' || CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR),
                   o_totalprice / (o_totalprice + 100) FROM orders)
SELECT kind, meth_sample_id, locus AS "probeName", round(value, 6) + 0.0 AS value FROM h2"""


@query("harmonise", _HARMONISED.rstrip() + _V1)
def harmonise_all(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    v1 = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("V1-"), fx.text("o_custkey")).alias("meth_sample_id"),
        fx.text("o_orderkey").alias("Name"),
        price.alias("MValue"),
        (price / (price + 100)).alias("Beta"),
    )
    mapping = fx.stored_probe_map(spark, sf)
    rows = harmonise.harmonise(fx.reports(spark, sf), v1, mapping)
    return rows.withColumn("value", rounded("value"))


# --- new samples ---------------------------------------------------------------------------------


@query(
    "sample_id_from_file",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MysterySample' ELSE c_name END AS sample_id
       FROM customer""",
)
def sample_id_from_file(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.when(F.col("c_custkey") % 3 == 0, "_report.csv").otherwise(ids.REPORT_SUFFIX)
    name = F.concat("c_name", ending)
    return fx.table(spark, sf, "customer").select(
        "c_custkey", ids.sample_id_from_file(name).alias("sample_id")
    )


_RAW_ID = """CASE c_custkey % 3
  WHEN 0 THEN 'P' || lpad(CAST(c_custkey AS STRING), 6, '0') || '_244263_T_W'
  WHEN 1 THEN lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || '_T_W'
  ELSE 'sample ' || CAST(c_custkey AS STRING) END"""


@query(
    "patient_id",
    f"""WITH raw AS (SELECT c_custkey, {_RAW_ID} AS sample_id FROM customer)
    SELECT c_custkey, sample_id,
           nullif(regexp_extract(sample_id, 'P[0-9]*|[0-9]{{2}}-[0-9]{{4}}'), '') AS patient_id FROM raw""",
)
def patient_id(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.table(spark, sf, "customer").select("c_custkey", F.expr(_RAW_ID).alias("sample_id"))
    return raw.withColumn("patient_id", ids.patient_id(F.col("sample_id")))


_OUTPUTS = """
outs AS (SELECT DISTINCT meth_sample_id, 'M' AS kind FROM ev WHERE day < 8
         UNION SELECT DISTINCT meth_sample_id, 'Beta' FROM ev WHERE day < 12)"""


def _outputs(ev: DataFrame) -> DataFrame:
    first = ev.filter("day < 8").select("meth_sample_id", F.lit("M").alias("kind"))
    second = ev.filter("day < 12").select("meth_sample_id", F.lit("Beta").alias("kind"))
    return first.unionByName(second).distinct()


@query(
    "new_samples",
    f"""WITH {fx.EVENTS}, {_OUTPUTS}
    SELECT DISTINCT meth_sample_id FROM ev WHERE meth_sample_id NOT IN (
      SELECT meth_sample_id FROM outs GROUP BY 1 HAVING count(DISTINCT kind) = 2)""",
)
def new_samples(spark: SparkSession, sf: str) -> DataFrame:
    ev = fx.event_values(spark, sf)
    return ingest.new_samples(ev.select("meth_sample_id").distinct(), _outputs(ev))


@query(
    "unloaded_samples",
    f"""WITH {fx.EVENTS} SELECT DISTINCT meth_sample_id FROM ev
    EXCEPT SELECT meth_sample_id FROM ev WHERE day < 8""",
)
def unloaded_samples(spark: SparkSession, sf: str) -> DataFrame:
    ev = fx.event_values(spark, sf)
    return ingest.unloaded_samples(ev, ev.filter("day < 8"))



@query(
    "append_samples",
    f"""WITH {fx.EVENTS}
    SELECT sample_id, meth_sample_id, probe_id, value FROM ev
    WHERE day < 8 OR probe_id IN (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error')""",
)
def append_samples(spark: SparkSession, sf: str) -> DataFrame:
    ev = fx.event_values(spark, sf)
    features = ev.filter("probe_id <> 'error'").select("probe_id")
    # The whole table comes in; what is loaded already must not come twice.
    return ingest.append_samples(ev.filter("day < 8"), ev, features)


@query(
    "missing_probes",
    f"""WITH {fx.EVENTS}, f AS (SELECT DISTINCT probe_id FROM ev), s AS (SELECT DISTINCT sample_id FROM ev)
    SELECT s.sample_id, f.probe_id FROM s CROSS JOIN f
    EXCEPT SELECT sample_id, probe_id FROM ev WHERE value IS NOT NULL""",
)
def missing_probes(spark: SparkSession, sf: str) -> DataFrame:
    ev = fx.event_values(spark, sf)
    return ingest.missing_probes(ev, ev.select("probe_id"))


@query(
    "ingest_stream",
    _HARMONISED
    + """SELECT 'W-' || meth_sample_id AS sample_id, meth_sample_id, locus AS probe_id,
    round(value, 6) + 0.0 AS value FROM h
    WHERE kind = 'M' AND locus IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P')""",
)
def ingest_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Streaming run over report files; the second run must add nothing."""
    root = _report_folder(spark, sf)
    target, checkpoint = scratch_path(spark, "table"), scratch_path(spark, "offsets")
    mapping = fx.stored_probe_map(spark, sf)
    features = (
        fx.table(spark, sf, "orders")
        .filter("o_orderstatus <> 'P'")
        .select(fx.text("o_orderkey").alias("probe_id"))
    )
    samples = fx.reports(spark, sf).select("meth_sample_id").distinct().withColumn(
        "sample_id", F.concat(F.lit("W-"), "meth_sample_id")
    )
    for _ in range(2):
        ingest_stream.ingest_reports(
            spark, root, target, checkpoint, mapping, features, samples, folders=True
        )
    return ingest_stream.loaded(spark, target).withColumn("value", rounded("value"))


# --- value scales ------------------------------------------------------------------------------------

_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(
    "m_to_beta",
    f"""WITH {fx.M} SELECT sample_id, probe_id,
    round(pow(2e0, value) / (pow(2e0, value) + 1), 6) + 0.0 AS beta FROM m""",
)
def m_to_beta(spark: SparkSession, sf: str) -> DataFrame:
    beta = numeric.m_to_beta(F.col("value"))
    return fx.measurements(spark, sf).select("sample_id", "probe_id", rounded(beta).alias("beta"))


@query(
    "beta_to_m",
    f"""SELECT {_KEYS}, round(log2(least(greatest(l_discount, 1e-6), 1 - 1e-6)
       / (1 - least(greatest(l_discount, 1e-6), 1 - 1e-6))), 6) + 0.0 AS m FROM lineitem""",
)
def beta_to_m(spark: SparkSession, sf: str) -> DataFrame:
    m = numeric.beta_to_m(F.col("l_discount"))
    return fx.table(spark, sf, "lineitem").select(*_KEYS.split(", "), rounded(m).alias("m"))


@query(
    "signal_to_m_beta",
    f"""SELECT {_KEYS},
    round(log2((l_extendedprice + 100) / (l_quantity + 100)), 6) + 0.0 AS m,
    round(l_extendedprice / (l_extendedprice + l_quantity + 100), 6) + 0.0 AS beta FROM lineitem""",
)
def signal_to_m_beta(spark: SparkSession, sf: str) -> DataFrame:
    signals = (F.col("l_extendedprice"), F.col("l_quantity"))
    return fx.table(spark, sf, "lineitem").select(
        *_KEYS.split(", "),
        rounded(numeric.signal_to_m(*signals, 100.0)).alias("m"),
        rounded(numeric.signal_to_beta(*signals, 100.0)).alias("beta"),
    )
