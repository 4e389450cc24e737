"""Time the headline queries and print one JSON line.

Tables come from $BENCH_SF_DIR; Spark runs on local[$BENCH_CPUS].  Every query is
run to the end with all its rows written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cpgspark.catalogue import load  # noqa: E402
from cpgspark.catalogue.q_models import chosen_vectors, part_of  # noqa: E402
from cpgspark.catalogue.q_quality import split_file_rows, written_splits  # noqa: E402
from cpgspark.operators.train import train_forest  # noqa: E402
from cpgspark.session import get_session  # noqa: E402

HEADLINE = (
    # wide matrix in, splits out, rows counted per split
    "wide_to_long",
    "ids_only",
    "write_splits",
    "split_row_counts",
    "split_profile",
    "split_ids",
    # probe and sample filters
    "filter_all",
    "filter_report",
    "drop_incomplete_probes",
    # array versions and new samples
    "probe_map",
    "replace_with_mean",
    "harmonise",
    "missing_probes",
    "append_samples",
    # tree
    "build_tree",
    "samples_recursive",
    "tree_edges",
    "trainable_nodes",
    "stratified_holdout",
    # statistics
    "dm_class_stats",
    "dm_best_class",
    "dm_select",
    "bh_fdr_all",
    "anova_f",
    "moderated_dm",
    # evaluation
    "core_metrics",
    "class_report",
    "roc_auc",
    "correct_call_distribution",
    # imputation and models
    "mean_impute",
    "knn_impute",
    "train_forest",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    # Start the JVM's code paths and a Python worker before the clock runs.
    spark.read.parquet(f"{sf}/region.parquet").groupBy("r_name").count().collect()
    queries["welch_p"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    # The work of the baseline's own figures alone, on inputs that lie ready.
    target = written_splits(spark, sf)
    start = time.perf_counter()
    split_file_rows(spark, target).collect()
    seconds["count_written_split_rows"] = round(time.perf_counter() - start, 3)
    vectors, features = chosen_vectors(spark, sf)
    start = time.perf_counter()
    train_forest(part_of(vectors, "train"), features)
    seconds["fit_forest_200_trees"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.rsplit("sf", 1)[-1]) if "sf" in sf else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
