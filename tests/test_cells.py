"""Filters, harmonisation, ingest, sources, streaming on small hand-made frames."""

from __future__ import annotations

import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cpgspark.functions import identifiers as ids
from cpgspark.functions import numeric
from cpgspark.operators import harmonise, ingest, qc, splits
from cpgspark.sources import sinks, tables, wide_csv
from cpgspark.streaming import ingest_stream

M = "sample_id string, probe_id string, value double"


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- values and names ------------------------------------------------------------


def test_scales_are_inverse(spark):
    df = spark.createDataFrame([(-12.5,), (0.0,), (3.25,), (800.0,), (None,)], "m double")
    beta = numeric.m_to_beta(F.col("m"))
    got = [tuple(r) for r in df.select("m", beta.alias("b"), numeric.beta_to_m(beta).alias("m2")).collect()]
    for m, b, back in got:
        if m is None:
            assert b is None and back is None
        elif abs(m) < 15:
            assert back == pytest.approx(m, abs=1e-6)
        else:
            assert b == 1.0 and back == pytest.approx(math.log2((1 - 1e-6) / 1e-6))


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1.5",), ("NA",), ("inf",), ("-Infinity",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(numeric.to_number(F.col("v"))).collect()] == [1.5] + [None] * 5
    assert [r[0] for r in df.select(numeric.clean_numeric(F.col("v"))).collect()] == [1.5] + [0.0] * 5


def test_names(spark):
    df = spark.createDataFrame(
        [("ann_t_methylation_anno_hg38.txt", "P000101_244263_T_W"), ("x.csv", "06-0086_410877_T_W"),
         (None, "plain"), ("_methylation_anno_hg38.txt", "xP")],
        "f string, s string",
    )
    got = df.select(ids.sample_id_from_file(F.col("f")), ids.patient_id(F.col("s"))).collect()
    # The suffix is cut off as a whole: the stem keeps letters that it shares with it.
    assert [r[0] for r in got] == ["ann_t", "MysterySample", "MysterySample", ""]
    assert [r[1] for r in got] == ["P000101", "06-0086", None, "P"]


# --- filters ------------------------------------------------------------------------


def _m(spark):
    rows = [("s1", "a", 1.0), ("s1", "b", None), ("s1", "c", 1.0),
            ("s2", "a", 2.0), ("s2", "b", 2.0), ("s2", "c", 2.0), ("s3", "a", 3.0), ("s3", "c", 3.0)]
    return spark.createDataFrame(rows, M)


def test_absent_row_and_null_are_both_missing(spark):
    m = _m(spark)
    assert {r[0] for r in _rows(qc.drop_incomplete_probes(m), "probe_id")} == {"a", "c"}
    assert {r[0] for r in _rows(qc.drop_sparse_samples(m, 0), "sample_id")} == {"s2"}
    assert {r[0] for r in _rows(qc.drop_sparse_samples(m, 1), "sample_id")} == {"s1", "s2", "s3"}


def test_filters_on_empty_input(spark):
    empty = spark.createDataFrame([], M)
    assert qc.drop_incomplete_probes(empty).count() == 0
    assert qc.drop_sparse_samples(empty).count() == 0


def test_report_agrees_with_the_filters(spark):
    m = _m(spark)
    meta = spark.createDataFrame(
        [("a", "G", "chr1"), ("b", "G", "chrX"), ("c", "G", "chr2")],
        "probe_id string, gencodebasic_name string, chr_hg38 string",
    )
    problems = spark.createDataFrame([("c", "Polymorphism"), ("a", "Other")], "probe_id string, reason string")
    report = {r["step"]: r for r in qc.filter_report(m, meta, problems, 0).collect()}
    assert report["xym_probes"]["probes_removed"] == 1
    assert report["sparse_samples"]["samples_removed"] == 0
    assert report["snp_probes"]["probes_after"] == 1
    kept = qc.filter_all(m, meta, problems, 0)
    last = report["cross_hybrid"]
    assert (last["samples_after"], last["probes_after"]) == (
        kept.select("sample_id").distinct().count(), kept.select("probe_id").distinct().count(),
    )


def test_purity_is_strict_and_must_be_known(spark):
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    purity = spark.createDataFrame([("a", 0.3), ("b", 0.31)], "biosample_id string, purity double")
    assert _rows(qc.purity_filter(samples, purity), "sample_id") == [("b",)]


# --- harmonisation ---------------------------------------------------------------------


def _reports(spark):
    rows = [
        ("s", "n1", "L1", 1.0), ("s", "n2", "L1", 3.0), ("s", "n3", "L1", 9.0),  # mean of n1, n2
        ("s", "n4", "L2", 5.0), ("s", "n5", "L2", 6.0),  # chosen probe absent, two values
        ("s", "n6", "L3", 7.0), ("s", "n7", "L3", 7.0),  # one value twice
        ("s", "n8", "L4", None), ("s", "n9", "L4", 2.0),  # null is a value of its own
        ("s", "n10", "L5", None), ("s", "n11", "L5", None),
        ("s", "n12", None, 1.0), ("t", "n1", "L1", 4.0),
        ("t", "m1", "L6", None), ("t", "m2", "L6", 8.0),  # chosen probe has no value
    ]
    return spark.createDataFrame(rows, "meth_sample_id string, Name string, EPICv1_Loci string, MValue double")


def _mapping(spark):
    return spark.createDataFrame(
        [("L1", ["n1", "n2"]), ("L2", ["zz"]), ("L6", ["m1"])], "EPICv1locmatch string, IlmnID array<string>"
    )


def test_means_then_single_values(spark):
    rows = harmonise.replace_with_mean(_reports(spark), _mapping(spark), "MValue")
    got = {(r[0], r[1]): r[2] for r in harmonise.resolve_loci(rows, "MValue").collect()}
    assert got == {("s", "L1"): 2.0, ("s", "L3"): 7.0, ("s", "L5"): None, ("t", "L1"): 4.0, ("t", "L6"): None}
    both = harmonise.harmonise_v2(_reports(spark), _mapping(spark), ["MValue"])
    assert {(r[0], r[1]): r[3] for r in both.collect()} == got


def test_probe_map_rules(spark):
    sup, best = "Superior probe", "Best precision"
    rows = [("a1", "A", sup), ("a2", "A", best), ("b1", "B", best), ("b2", "B", None), ("c1", "C", None),
            ("c2", "C", "Inferior probe"), ("d1", "D", sup)]
    rows += [(f"e{i}", "E", sup) for i in range(7)]
    man = spark.createDataFrame(rows, "IlmnID string, EPICv1locmatch string, Rep_results_by_NAME string")
    got = {r[0]: list(r[1]) for r in harmonise.probe_map(man).collect()}
    assert got == {"A": ["a1"], "B": ["b1"]}
    assert _rows(harmonise.probe_map_unresolved(man), "IlmnID") == [("c1",), ("c2",)]


def test_v1_report_without_m_is_skipped(spark):
    v1 = spark.createDataFrame([("s", "n", 0.5)], "meth_sample_id string, Name string, Beta double")
    with pytest.raises(ValueError):
        harmonise.harmonise(None, v1, _mapping(spark))


# --- new samples ---------------------------------------------------------------------------


def test_append_skips_known_and_foreign(spark):
    schema = "sample_id string, meth_sample_id string, probe_id string, value double"
    old = spark.createDataFrame([("a", "am", "p", 1.0)], schema)
    new = spark.createDataFrame([("a", "am", "p", 9.0), ("b", "bm", "p", 2.0), ("b", "bm", "zz", 3.0)], schema)
    features = spark.createDataFrame([("p",), ("q",)], "probe_id string")
    out = ingest.append_samples(old, new, features)
    assert _rows(out, "sample_id", "probe_id", "value") == [("a", "p", 1.0), ("b", "p", 2.0)]
    assert ingest.append_samples(out, new, features).count() == 2
    assert _rows(ingest.missing_probes(new, features), "sample_id", "probe_id") == [("a", "q"), ("b", "q")]
    nameless = spark.createDataFrame([(None, "cm", "p", 1.0)], schema)
    with pytest.raises(ValueError):
        ingest.append_samples(old, nameless, features)


def test_new_sample_needs_both_outputs(spark):
    reports = spark.createDataFrame([("a",), ("b",), ("c",)], "meth_sample_id string")
    outs = spark.createDataFrame([("a", "M"), ("a", "Beta"), ("b", "M")], "meth_sample_id string, kind string")
    assert _rows(ingest.new_samples(reports, outs), "meth_sample_id") == [("b",), ("c",)]


# --- sources and sinks -------------------------------------------------------------------------


def _write(path: Path, text: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_wide_csv_and_its_errors(spark, tmp_path):
    good = _write(tmp_path / "a.csv", "biosample_id,p1,p2\ns1,1.5,\n\ns2,NA,-inf\n")
    assert _rows(wide_csv.read_wide(spark, good), "sample_id", "probe_id", F.coalesce("value", F.lit(-1.0))) == [
        ("s1", "p1", 1.5), ("s1", "p2", -1.0), ("s2", "p1", -1.0), ("s2", "p2", -1.0)]
    with pytest.raises(ValueError, match="expected first column"):
        wide_csv.read_wide(spark, _write(tmp_path / "b.csv", "id,p1\ns1,1\n"))
    with pytest.raises(ValueError, match="duplicate"):
        wide_csv.read_wide(spark, _write(tmp_path / "c.csv", "biosample_id,p1\ns1,1\ns1,2\n"))
    with pytest.raises(ValueError, match="no ids"):
        wide_csv.read_wide(spark, _write(tmp_path / "d.csv", "biosample_id,p1\n"))


def test_split_files_keep_lines_and_header(spark, tmp_path):
    lines = [f's{i},{i}.50,"x"' for i in range(20)]
    source = _write(tmp_path / "m.csv", "biosample_id,p1,p2\n" + "\n".join(lines) + "\n")
    parts = splits.split_ids(wide_csv.read_ids(spark, source), "biosample_id")
    wide_csv.write_splits(spark, source, str(tmp_path / "out"), parts)
    seen = []
    for name in ("train", "val", "test"):
        for file in (tmp_path / "out" / f"split={name}").glob("*.csv"):
            head, *rest = file.read_text().splitlines()
            assert head == "biosample_id,p1,p2"
            seen += rest
    assert sorted(seen) == sorted(lines)


def test_reports_as_files(spark, tmp_path):
    head = "Name\tEPICv1_Loci\tMValue\tBeta\tManifest_probe_match\tStart_hg38\n"
    _write(tmp_path / "r/deep/S9_T_methylation_anno_hg38.txt", head + "n1\tL1\t1.5\t0.5\tNA\t12.0\nn2\tNA\tNA\t0.1\ty\tNA\n")
    _write(tmp_path / "r/other.txt", "noise\n")
    root = str(tmp_path / "r")
    assert _rows(tables.discover_reports(spark, root), "meth_sample_id") == [("S9_T",)]
    rows = {r["Name"]: r for r in tables.read_array_report(spark, root).collect()}
    assert rows["n1"]["meth_sample_id"] == "S9_T" and rows["n1"]["Start_hg38"] == 12.0
    assert rows["n2"]["EPICv1_Loci"] is None and rows["n2"]["MValue"] is None


def test_each_report_is_read_by_its_own_header(spark, tmp_path):
    end = ids.REPORT_SUFFIX
    files = {
        "V2": "Name\tEPICv1_Loci\tMValue\tBeta\nn1\tL1\t1.5\t0.5\n",
        "V1": "Name\tMValue\tBeta\tStart_hg38\nn1\t2.5\t0.8\t7\r\nn2\tNaN\t-Inf\tNA\n",
        "MIXED": 'Beta\tMValue\t"EPICv1_Loci"\tName\n0.25\t-1.0\t"L2"\t"n3"\n',
        "NONE": "Name\tEPICv1_Loci\tBeta\nn1\tL1\t0.5\n",
        "EMPTY": "",
    }
    for name, text in files.items():
        _write(tmp_path / f"r/{name}{end}", text)
    root = str(tmp_path / "r")
    second = tables.read_array_report(spark, root)
    assert second.columns == ["meth_sample_id", *tables.REPORT_V2.names]
    assert _rows(second, "meth_sample_id", "Name", "EPICv1_Loci", "MValue", "Beta") == [
        ("MIXED", "n3", "L2", -1.0, 0.25), ("V2", "n1", "L1", 1.5, 0.5)]
    first = {r["Name"]: r for r in tables.read_array_report(spark, root, v2=False).collect()}
    assert set(first) == {"n1", "n2"} and first["n1"]["MValue"] == 2.5
    assert first["n1"]["Beta"] == 0.8 and first["n1"]["Start_hg38"] == 7.0
    assert first["n2"]["MValue"] is None and first["n2"]["Beta"] is None


def test_labels_need_their_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="missing"):
        tables.read_labels(spark, _write(tmp_path / "l.csv", "biosample_id,x\na,1\n"))


def test_scan_filter_sink_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    _m(spark).write.parquet(source)
    keep = spark.createDataFrame([("a",), ("b",)], "probe_id string")
    drop = spark.createDataFrame([("b",)], "probe_id string")
    for fmt in ("parquet", "csv"):
        assert sinks.scan_filter_sink(spark, source, str(tmp_path / fmt), keep, drop, fmt) == 3


def test_samples_out_and_long_to_map(spark, tmp_path):
    schema = "kind string, meth_sample_id string, probeName string, value double"
    rows = [("M", "s1", "p", 1.0), ("Beta", "s1", "p", 0.5), ("M", "s2", "p", 2.0)]
    out = str(tmp_path / "samples")
    sinks.write_samples(spark.createDataFrame(rows, schema), out)
    assert _rows(sinks.written_samples(spark, out), "meth_sample_id", "kind") == [
        ("s1", "Beta"), ("s1", "M"), ("s2", "M")]
    wide = {r[0]: r[1] for r in sinks.long_to_wide(_m(spark)).collect()}
    assert wide["s1"] == {"a": 1.0, "c": 1.0}
    target = str(tmp_path / "m")
    sinks.write_measurements(_m(spark), target)
    assert spark.read.parquet(target).count() == 8


# --- streaming ------------------------------------------------------------------------------------


def test_stream_loads_each_sample_once(spark, tmp_path):
    head = "Name\tEPICv1_Loci\tMValue\tBeta\tManifest_probe_match\tStart_hg38\n"
    root, table, marks = (str(tmp_path / d) for d in ("raw", "table", "marks"))
    end = ids.REPORT_SUFFIX
    _write(tmp_path / f"raw/A{end}", head + "n1\tL1\t1.0\t0.5\tNA\tNA\nn2\tL1\t3.0\t0.5\tNA\tNA\nn9\tL9\t7.0\t0.5\tNA\tNA\n")
    features = spark.createDataFrame([("L1",)], "probe_id string")
    samples = spark.createDataFrame([("a", "A"), ("b", "B")], "sample_id string, meth_sample_id string")

    def run():
        ingest_stream.ingest_reports(spark, root, table, marks, _mapping(spark), features, samples)
        return _rows(ingest_stream.loaded(spark, table), "sample_id", "probe_id", "value")

    assert run() == [("a", "L1", 2.0)]
    assert run() == [("a", "L1", 2.0)]
    _write(tmp_path / f"raw/B{end}", head + "n1\tL1\t5.0\t0.5\tNA\tNA\n")
    # The same sample again in another folder is known and must not come twice.
    _write(tmp_path / f"raw/again/A{end}", head + "n1\tL1\t8.0\t0.5\tNA\tNA\n")
    _write(tmp_path / f"raw/C{end}", head + "n1\tL1\t6.0\t0.5\tNA\tNA\n")
    assert run() == [("a", "L1", 2.0), ("b", "L1", 5.0)]


def test_stream_takes_both_versions_later_parts_and_late_ids(spark, tmp_path):
    root, table, marks = (str(tmp_path / d) for d in ("raw", "table", "marks"))
    end = ids.REPORT_SUFFIX
    second = "Name\tEPICv1_Loci\tMValue\tBeta\n"
    _write(tmp_path / f"raw/A{end}/part-0", second + "n1\tL1\t1.0\t0.5\nn8\tL8\t4.0\t0.5\n")
    _write(tmp_path / f"raw/V{end}/part-0", "Beta\tName\tMValue\n0.5\tL1\t9.0\n")
    _write(tmp_path / f"raw/C{end}/part-0", second + "n8\tL8\t6.0\t0.5\n")
    features = spark.createDataFrame([("L1",), ("L8",)], "probe_id string")
    schema = "sample_id string, meth_sample_id string"

    def run(*named):
        samples = spark.createDataFrame(list(named), schema)
        ingest_stream.ingest_reports(
            spark, root, table, marks, _mapping(spark), features, samples, folders=True
        )
        return _rows(ingest_stream.loaded(spark, table), "sample_id", "probe_id", "value")

    some = [("a", "A"), ("v", "V")]
    assert run(*some) == [("a", "L1", 1.0), ("a", "L8", 4.0), ("v", "L1", 9.0)]
    # A later part: the mean over both probes of the locus, not over the later one.
    _write(tmp_path / f"raw/A{end}/part-1", second + "n2\tL1\t3.0\t0.5\n")
    want = [("a", "L1", 2.0), ("a", "L8", 4.0), ("c", "L8", 6.0), ("v", "L1", 9.0)]
    assert run(*some, ("c", "C")) == want
    assert run(*some, ("c", "C")) == want


def test_repeated_batch_replaces_itself(spark, tmp_path):
    batch = spark.createDataFrame([("a", "A", "p", 1.0)], ingest_stream.TABLE_SCHEMA)
    for _ in range(2):
        ingest_stream.append_new(batch, 0, str(tmp_path))
    assert ingest_stream.loaded(spark, str(tmp_path)).count() == 1


# --- splits --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "want"), [(1, (1, 0, 0)), (3, (2, 0, 1)), (390, (273, 58, 59))])
def test_split_sizes(spark, n, want):
    ids_df = spark.range(n).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"))
    parts = splits.split_ids(ids_df, "id")
    counts = {r[0]: r[1] for r in parts.groupBy("split").count().collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == want
    assert parts.select("id").distinct().count() == n
    again = splits.split_ids(ids_df.repartition(3), "id")
    assert _rows(parts, "id", "split") == _rows(again, "id", "split")


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        splits.split_ids(spark.range(3), "id", (0.5, 0.2, 0.2))


def test_stored_manifest(spark):
    doc = {"seed": 42, "ids": {"train": ["a", "b"], "val": ["c"], "test": []}}
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    assert _rows(splits.manifest_assignments(df), "sample_id", "split") == [
        ("a", "train"), ("b", "train"), ("c", "val")]


@pytest.mark.parametrize("per_line", [1000, 3])
def test_manifest_file_is_one_json_document(spark, tmp_path, monkeypatch, per_line):
    monkeypatch.setattr(sinks, "IDS_PER_LINE", per_line)
    odd = ['a"b', "c,d", ",e", "[f]", "g\\h", "\u00e9\n", "", "]}}"] + [f"s{i}" for i in range(90)]
    parts = splits.split_ids(spark.createDataFrame([(i,) for i in odd], "biosample_id string"), "biosample_id")
    target = str(tmp_path / "manifest")
    sinks.write_manifest(parts, target, "biosample_id", 'data/"x".csv')
    files = sorted((tmp_path / "manifest").glob("section=*/part-*.txt"))
    doc = json.loads("".join(f.read_text() for f in files))
    assert list(doc) == ["input_csv", "ratios", "seed", "id_col", "counts", "ids"]
    assert doc["input_csv"] == 'data/"x".csv' and doc["ratios"] == [0.7, 0.15, 0.15]
    assert doc["counts"] == {"total": 98, "train": 68, "val": 14, "test": 16}
    want = _rows(parts.withColumnRenamed("biosample_id", "sample_id"), "sample_id", "split")
    assert sorted((i, s) for s, ids in doc["ids"].items() for i in ids) == want
    assert _rows(sinks.written_assignments(spark, target), "sample_id", "split") == want
    whole = spark.createDataFrame([(json.dumps(doc),)], "value string")
    assert _rows(splits.manifest_assignments(whole), "sample_id", "split") == want
    assert sinks.written_settings(spark, target).first()["counts"]["val"] == 14


def test_manifest_file_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id string, split string")
    target = str(tmp_path / "none")
    sinks.write_manifest(none, target, "id")
    files = sorted((tmp_path / "none").glob("section=*/part-*.txt"))
    assert json.loads("".join(f.read_text() for f in files))["ids"] == {"train": [], "val": [], "test": []}
    assert sinks.written_assignments(spark, target).count() == 0


def test_adaptive_folds(spark):
    rows = spark.createDataFrame([("a",)] * 9 + [("b",)], "label string")
    assert tuple(splits.adaptive_folds(rows, "label").first()) == (1, 2, "validation_set")
    rows = spark.createDataFrame([("a",)] * 9 + [("b",)] * 8, "label string")
    assert tuple(splits.adaptive_folds(rows, "label").first()) == (8, 5, "cross_validation")


def test_report_rows_meet_their_headers_without_a_shuffle(spark, tmp_path):
    folder = tmp_path / "S1_methylation_anno_hg38.txt"
    folder.mkdir()
    lines = ["MValue\tName\tEPICv1_Loci", '0.5\t"a"\tx', "NA\tName2\ty"]
    (folder / "part-0").write_text("\n".join(lines) + "\n")
    found = tables.read_array_report(spark, str(tmp_path), folders=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "regexp_extract" not in plan
    rows = [tuple(r) for r in found.select("meth_sample_id", "Name", "EPICv1_Loci", "MValue", "Beta").collect()]
    assert sorted(rows, key=str) == [("S1", "Name2", "y", None, None), ("S1", "a", "x", 0.5, None)]


def test_a_large_sample_is_written_by_several_tasks(spark, tmp_path):
    values = spark.range(0, 40_000, 1, 8).select(
        F.lit("M").alias("kind"), F.lit("s1").alias("meth_sample_id"),
        F.col("id").cast("string").alias("probeName"), F.rand(1).alias("value"),
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "32k")
    try:
        sinks.write_samples(values, str(tmp_path / "out"))
    finally:
        spark.conf.set(key, before)
    files = list((tmp_path / "out" / "kind=M" / "meth_sample_id=s1").glob("*.parquet"))
    assert len(files) > 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40_000
