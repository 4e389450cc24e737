from __future__ import annotations

import pytest
from pyspark.sql import Window, functions as F

from cpgspark.plans import durable, ordering, sizing


def _skewed(spark, n=2000):
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("g")
    )


@pytest.mark.parametrize("group", [[], ["g"]])
def test_seeded_rank_equals_plain_window(spark, group):
    df = _skewed(spark)
    key = ordering.seeded_hash("id", 7)
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    plain = df.select(
        "id", F.row_number().over(w.orderBy(key, "id")).alias("r"), F.count(F.lit(1)).over(w).alias("n")
    )
    got = ordering.seeded_rank(df, "id", 7, group).select("id", "rank", "group_size")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_equal_plain_window(spark, descending):
    df = _skewed(spark).select(
        "g", ((F.col("id") * 37) % 1999).cast("double").alias("v"), (F.col("id") % 3).alias("k")
    ).groupBy("g", "v").agg(F.sum("k").alias("k"))
    w = Window.partitionBy("g").orderBy(F.col("v").desc() if descending else F.col("v"))
    plain = df.select("g", "v", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    got = ordering.running_totals(df, ["g"], "v", {"k": "s"}, descending, buckets=16)
    assert sorted(map(tuple, got.select("g", "v", "s").collect())) == sorted(map(tuple, plain.collect()))


def test_running_totals_of_one_value(spark):
    df = spark.createDataFrame([("a", 0.5, 2)], "g string, v double, k int")
    row = ordering.running_totals(df, ["g"], "v", {"k": "s"}).first()
    assert (row["s"], row["s_all"]) == (2, 2)


@pytest.mark.parametrize("largest, descending", [(True, False), (False, True), (True, True)])
def test_running_extreme_equals_plain_window(spark, largest, descending):
    df = _skewed(spark).select("g", "id", ((F.col("id") * 37) % 1999).alias("v"))
    w = Window.partitionBy("g")
    df = df.withColumn("r", F.row_number().over(w.orderBy("id")))
    along = w.orderBy(F.col("r").desc() if descending else F.col("r")).rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("g", "r", (F.max if largest else F.min)("v").over(along).alias("x"))
    got = ordering.running_extreme(df, ["g"], "r", "v", "x", largest, descending, piece=100)
    assert sorted(map(tuple, got.select("g", "r", "x").collect())) == sorted(map(tuple, plain.collect()))


def test_running_totals_run_their_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    once = F.udf(seen, "double").asNondeterministic()
    df = spark.range(500).select(F.lit("g").alias("g"), once(F.col("id").cast("double")).alias("v"), F.lit(1).alias("k"))
    out = ordering.running_totals(df, ["g"], "v", {"k": "s"}, buckets=8)
    assert out.agg(F.max("s")).first()[0] == 500
    assert read.value == 500


def test_running_totals_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double, k int")
    assert ordering.running_totals(df, ["g"], "v", {"k": "s"}).count() == 0


def test_broadcast_only_when_small(spark):
    big, small = spark.range(1000), spark.range(10)

    def plan(df):
        return df._jdf.queryExecution().analyzed().toString()

    assert "strategy=broadcast" in plan(spark.range(5).join(sizing.small_side(small, 100), "id"))
    assert "strategy=broadcast" not in plan(spark.range(5).join(sizing.small_side(big, 100), "id"))


def test_scratch_is_in_the_named_folder(spark):
    folder = durable.shared_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or folder == named.rstrip("/")
    assert durable.scratch_path(spark, "x") != durable.scratch_path(spark, "x")


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        def __init__(self, master):
            self.sparkContext, self.conf, self.master = self, self, master

        def get(self, *_):
            return None

        getCheckpointDir = get  # noqa: N815

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            durable.shared_dir(Fake(master))
    assert durable.shared_dir(Fake("local[2]")) == durable.shared_dir(Fake("local[*]"))


def test_store_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "i int, a array<string>")
    back = durable.store(df, "t")
    assert back.schema == df.schema
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(1, ["a"]), (2, None)]
