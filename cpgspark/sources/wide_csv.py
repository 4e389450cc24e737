"""Very wide CSV matrices (one column per probe) as long measurements.

Spark's CSV reader wants one column per probe; a matrix of several hundred
thousand probes is read as text instead, split inside the JVM, one row per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cpgspark.functions.numeric import to_number

ID_COL = "biosample_id"


def read_header(spark: SparkSession, path: str, id_col: str = ID_COL) -> str:
    """First line of the file.  Every file of a folder must start with it."""
    first = spark.read.text(path).first()
    header = (first["value"] if first else "").strip()
    found = header.split(",", 1)[0]
    if found != id_col:
        raise ValueError(f"expected first column '{id_col}', got '{found}'")
    return header


def _line_id() -> Column:
    return F.substring_index("value", ",", 1)


def _data_lines(spark: SparkSession, path: str, header: str) -> DataFrame:
    line = F.trim("value")
    return spark.read.text(path).filter((line != "") & (line != header))


def read_ids(spark: SparkSession, path: str, id_col: str = ID_COL) -> DataFrame:
    """The id column alone; values are never split or parsed."""
    header = read_header(spark, path, id_col)
    return _data_lines(spark, path, header).select(_line_id().alias(id_col))


def check_ids(ids: DataFrame, id_col: str = ID_COL) -> None:
    """Refuse a matrix without ids or with an id twice."""
    counts = ids.groupBy(id_col).count()
    worst = counts.agg(F.max("count")).first()[0]
    if worst is None:
        raise ValueError("no ids found in the input")
    if worst > 1:
        raise ValueError("duplicate ids in the first column of the input")


def read_wide(
    spark: SparkSession, path: str, id_col: str = ID_COL, validate: bool = True
) -> DataFrame:
    """``sample_id, probe_id, value``; cells that are no finite number are null.

    Lines are split on bare commas.  The header travels as one array value, and a
    cell finds its probe name by position: nothing is joined or shuffled.
    """
    header = read_header(spark, path, id_col)
    if validate:
        check_ids(read_ids(spark, path, id_col), id_col)
    names = (
        spark.read.text(path)
        .filter(F.trim("value") == header)
        .select(F.split(F.trim("value"), ",").alias("names"))
        .limit(1)
    )
    cells = F.split("value", ",")
    return (
        _data_lines(spark, path, header)
        .select(_line_id().alias("sample_id"), F.posexplode(cells).alias("pos", "cell"))
        .filter("pos > 0")
        .select(
            "sample_id",
            F.get(names.scalar(), F.col("pos")).alias("probe_id"),
            to_number(F.trim("cell")).alias("value"),
        )
    )


def write_splits(
    spark: SparkSession,
    source: str,
    target: str,
    assignments: DataFrame,
    id_col: str = ID_COL,
) -> None:
    """Copy each line of the matrix into the folder of its split, in one pass.

    ``assignments`` is ``<id_col>, split``; ids without a split are not written.
    Lines stay untouched and every file starts with the header.
    """
    header = read_header(spark, source, id_col)
    lines = _data_lines(spark, source, header).withColumn("__id", _line_id())
    stored = assignments.select(F.col(id_col).cast("string").alias("__id"), "split")
    (
        lines.join(stored, "__id")
        .select(F.col("value").alias(header), "split")
        .write.partitionBy("split")
        .option("header", True)
        # One column under a separator that the text cannot hold: no quoting.
        .option("sep", "\u0001")
        .option("quote", "\u0000")
        .option("escapeQuotes", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(target)
    )
