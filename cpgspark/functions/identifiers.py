"""Column expressions for sample and file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# File suffix, patient-id pattern and fallback name must equal what
# existing sample stores use.
REPORT_SUFFIX = "_methylation_anno_hg38.txt"
PATIENT_ID_PATTERN = r"P\d*|\d{2}-\d{4}"
UNKNOWN_SAMPLE = "MysterySample"


def sample_id_from_file(file_name: Column, suffixes: Sequence[str] = (REPORT_SUFFIX,)) -> Column:
    """File name without its suffix; a fixed name where no suffix fits."""
    result = F.lit(UNKNOWN_SAMPLE)
    for suffix in reversed(suffixes):
        stem = F.substring(file_name, F.lit(1), F.length(file_name) - len(suffix))
        result = F.when(file_name.endswith(suffix), stem).otherwise(result)
    return result


def base_name(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def patient_id(sample_id: Column) -> Column:
    """Leftmost patient identifier inside a sample identifier, else null."""
    return F.nullif(F.regexp_extract(sample_id, PATIENT_ID_PATTERN, 0), F.lit(""))


def join_key(sample_id: Column) -> Column:
    """Identifier form used to match labels: trimmed, upper case."""
    return F.upper(F.trim(sample_id.cast("string")))
