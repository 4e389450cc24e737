"""Typed readers: array reports, manifests, labels, probe metadata, sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cpgspark.functions.identifiers import REPORT_SUFFIX, base_name, sample_id_from_file
from cpgspark.functions.numeric import finite
from cpgspark.plans.durable import store
from cpgspark.plans.sizing import small_side

# Column names of the input files.
REPORT_V1 = T.StructType(
    [
        T.StructField("Name", T.StringType()),
        T.StructField("MValue", T.DoubleType()),
        T.StructField("Beta", T.DoubleType()),
        T.StructField("Manifest_probe_match", T.StringType()),
        T.StructField("Start_hg38", T.DoubleType()),
    ]
)
REPORT_V2 = T.StructType(
    [
        T.StructField("Name", T.StringType()),
        T.StructField("EPICv1_Loci", T.StringType()),
        T.StructField("MValue", T.DoubleType()),
        T.StructField("Beta", T.DoubleType()),
        T.StructField("Manifest_probe_match", T.StringType()),
        T.StructField("Start_hg38", T.DoubleType()),
    ]
)
MANIFEST_V2 = T.StructType(
    [
        T.StructField("IlmnID", T.StringType()),
        T.StructField("Name", T.StringType()),
        T.StructField("EPICv1locmatch", T.StringType()),
        T.StructField("UCSC_RefGene_Name", T.StringType()),
        T.StructField("GencodeV41_Name", T.StringType()),
        T.StructField("Rep_results_by_NAME", T.StringType()),
        T.StructField("RMSE_with_WGBS", T.DoubleType()),
    ]
)
LABELS = T.StructType(
    [
        T.StructField("biosample_id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("disease_status", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)
PROBE_METADATA = T.StructType(
    [
        T.StructField("probe_id", T.StringType()),
        T.StructField("gencodebasic_name", T.StringType()),
        T.StructField("chr_hg38", T.StringType()),
    ]
)


def _report_location(root: str, suffix: str, folders: bool) -> tuple[str, dict[str, object]]:
    """Where the reports are: files anywhere below ``root`` whose name has the
    suffix, or, with ``folders``, folders of part files whose name has it."""
    options: dict[str, object] = {"recursiveFileLookup": True}
    if folders:
        return f"{root}/*{suffix}", options
    return root, {**options, "pathGlobFilter": f"*{suffix}"}


def report_sample_id(path: Column, suffix: str, folders: bool) -> Column:
    """Sample id out of the path of a report."""
    if folders:
        return F.regexp_extract(path, "([^/=]+)" + suffix.replace(".", "[.]") + "/", 1)
    return sample_id_from_file(base_name(path), [suffix])


def discover_reports(
    spark: SparkSession, root: str, suffix: str = REPORT_SUFFIX, folders: bool = False
) -> DataFrame:
    """``file_name, meth_sample_id`` of every report below a folder.

    Only names are listed; file contents are never read.
    """
    where, options = _report_location(root, suffix, folders)
    files = spark.read.format("binaryFile").options(**options).load(where)
    return files.select(
        F.col("path").alias("file_name"),
        report_sample_id(F.col("path"), suffix, folders).alias("meth_sample_id"),
    )


def report_lines(
    spark: SparkSession,
    root: str,
    suffix: str = REPORT_SUFFIX,
    folders: bool = False,
    stream: bool = False,
) -> DataFrame:
    """``meth_sample_id, file, value``: the lines of all raw reports below a folder.

    With ``stream`` the files are read as they arrive, each whole in one batch.
    """
    where, options = _report_location(root, suffix, folders)
    reader = spark.readStream if stream else spark.read
    rows = reader.options(**options).text(where)
    path = F.col("_metadata.file_path")
    return rows.select(
        report_sample_id(path, suffix, folders).alias("meth_sample_id"),
        path.alias("file"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("value"),
    )


def parse_reports(lines: DataFrame) -> DataFrame:
    """Report lines as typed rows, each file by its own header.

    A file with the column ``EPICv1_Loci`` is ``version`` v2, any other v1; one without
    ``MValue`` is skipped.  Columns are found by name, so their order is free and a
    lacking one is null, as are ``NA`` and numbers that are not finite.  The header is
    the line that has ``Name`` as a cell; a file has one, so headers are few and small.
    """
    quote = F.lit('"')
    cells = F.transform(F.split("value", "\t", -1), lambda x: F.btrim(x, quote))
    # The text is searched first: only lines that can be headers are cut up for the test.
    is_header = F.col("value").contains("Name") & F.array_contains(cells, "Name")
    filled = lines.filter(F.col("value") != "")
    headers = (
        filled.filter(is_header)
        .groupBy("file")
        .agg(F.min(cells).alias("header"), F.min("meth_sample_id").alias("meth_sample_id"))
        .filter(F.array_contains("header", "MValue"))
    )
    version = F.when(F.array_contains("header", "EPICv1_Loci"), "v2").otherwise("v1")
    places = [F.array_position("header", f.name).alias(f"__{f.name}") for f in REPORT_V2.fields]
    # Read once and sent to the rows, which are not shuffled; the id, cut out of a file's path,
    # is worked out for its header alone.
    known = small_side(store(headers.select("meth_sample_id", "file", version.alias("version"), *places), "headers"))

    def cell(field: T.StructField) -> Column:
        place = F.col(f"__{field.name}")
        text = F.when(place > 0, F.btrim(F.get("cells", (place - 1).cast("int")), quote))
        known = F.when(~text.isin("NA", ""), text)
        if isinstance(field.dataType, T.DoubleType):
            known = finite(known.try_cast("double"))
        return known.alias(field.name)

    split = filled.filter(~is_header).select("file", F.split("value", "\t", -1).alias("cells"))
    return split.join(known, "file").select(
        "meth_sample_id", "file", "version", *[cell(f) for f in REPORT_V2.fields]
    )


def read_array_report(
    spark: SparkSession,
    root: str,
    v2: bool = True,
    suffix: str = REPORT_SUFFIX,
    folders: bool = False,
) -> DataFrame:
    """All raw reports of one array version below a folder, with the sample id.

    Reports of the other version, and those without ``MValue``, are left out.
    """
    rows = parse_reports(report_lines(spark, root, suffix, folders))
    schema = REPORT_V2 if v2 else REPORT_V1
    return rows.filter(F.col("version") == ("v2" if v2 else "v1")).select(
        "meth_sample_id", *schema.names
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Second-generation probe manifest; ``NA`` is null."""
    return (
        spark.read.option("header", True).option("nullValue", "NA").schema(MANIFEST_V2).csv(path)
    )


def read_probe_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(PROBE_METADATA).csv(path)


def require_columns(df: DataFrame, *names: str) -> None:
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"required column is missing: {lacking}")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``biosample_id, label``; other columns of the file are not kept."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, "biosample_id", "label")
    return raw.select("biosample_id", "label")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Long measurements stored as Parquet."""
    schema = "sample_id string, meth_sample_id string, probe_id string, value double"
    return spark.read.schema(schema).parquet(path)
