"""Sample vectors for ``pyspark.ml``, built after selection has cut the probes."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from cpgspark.functions.numeric import finite
from cpgspark.plans.sizing import small_side

#: Probes in one model's vector: the limit of a dense vector that many trees share.
MAX_FEATURES = 65_535


def probe_names(probes: DataFrame) -> list[str]:
    """All probes in name order; an array has below a million."""
    rows = probes.select("probe_id").distinct().orderBy("probe_id")
    return [r["probe_id"] for r in rows.collect()]


def feature_places(probes: DataFrame) -> list[str]:
    """The selected probes of a model in name order.

    This list is part of the model.  More than one vector can serve is refused.
    """
    names = probe_names(probes)
    if len(names) > MAX_FEATURES:
        raise ValueError("select fewer probes before building vectors")
    return names


def _places(m: DataFrame, features: list[str]) -> DataFrame:
    rows = [(p, i) for i, p in enumerate(features)]
    return small_side(m.sparkSession.createDataFrame(rows, "probe_id string, place int"))


def _dense(size: int, fill: float) -> Column:
    """Array of ``size`` values from lists of ``place`` and ``value``; gaps get ``fill``."""
    # By native array functions: one lambda a gap, none for a sample that has every cell.
    every = F.sequence(F.lit(0), F.lit(size - 1)) if size else F.array().cast("array<int>")
    gaps = F.transform(
        F.array_except(every, F.col("place")),
        lambda i: F.struct(i.alias("place"), F.lit(fill).alias("value")),
    )
    return F.sort_array(F.concat(F.arrays_zip("place", "value"), gaps))["value"]


def sample_arrays(
    m: DataFrame, features: list[str], fill: float = 0.0, gaps: bool = False
) -> DataFrame:
    """``sample_id, values``: one array per sample in feature order.

    A missing value, or one that is no finite number, takes ``fill``.  A sample with
    rows for other probes only has ``fill`` everywhere: the join keeps such rows, and
    they fold into their sample before the shuffle.  The group of a sample holds at most
    one cell per feature.  With ``gaps`` also the places without a row or with a null value only.
    """
    held = F.col("value").isNotNull() & F.col("place").isNotNull()
    # Two lists of plain numbers, filled row by row together, take half the time of one of pairs.
    lists = [F.collect_list(F.when(held, F.col(c))).alias(c) for c in ("place", "value")]
    if gaps:
        odd = F.col("value").isNull() & F.col("__given")
        lists.append(F.collect_list(F.when(odd, F.col("place"))).alias("odd"))
    known = (
        m.withColumn("__given", F.col("value").isNotNull())
        .withColumn("value", finite(F.col("value").cast("double")))
        .join(_places(m, features), "probe_id", "left")
        .groupBy("sample_id")
        .agg(*lists)
    )
    columns = ["sample_id", _dense(len(features), fill).alias("values")]
    if gaps:
        every = F.sequence(F.lit(0), F.lit(len(features) - 1)) if features else F.array().cast("array<int>")
        columns.append(F.array_except(every, F.concat("place", "odd")).alias("gaps"))
    return known.select(*columns)


def sample_vectors(m: DataFrame, features: list[str]) -> DataFrame:
    """``sample_id, features``: dense ML vectors, missing as 0."""
    return sample_arrays(m, features).select(
        "sample_id", array_to_vector("values").alias("features")
    )


def pick(arrays: DataFrame, names: list[str], features: list[str]) -> DataFrame:
    """``features`` vectors of one model out of arrays over ``names``; other columns stay."""
    if features == names:  # nothing to look up
        values = F.slice("values", 1, len(names))
        return arrays.withColumn("features", array_to_vector(values)).drop("values")
    place = {name: i for i, name in enumerate(names)}
    # One value in the plan, folded to an array, however many the features.
    places = F.split(F.lit(",".join(str(place[f]) for f in features)), ",").cast("array<int>")
    values = F.transform(places, lambda i: F.get("values", i))
    return arrays.withColumn("features", array_to_vector(values)).drop("values")


def class_weights(
    labelled: DataFrame, label_col: str = "class", counted: dict[str, int] | None = None
) -> DataFrame:
    """Add ``weight`` = n / (classes * n of the class); ``counted`` has the n, where known."""
    if counted:
        whole = sum(counted.values())
        weights = {c: whole / (len(counted) * n) for c, n in counted.items()}
        return _weighted(labelled, label_col, weights)
    sizes = labelled.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    everyone = Window.partitionBy()  # one row per class
    weight = F.sum("n_class").over(everyone) / (
        F.count(F.lit(1)).over(everyone) * F.col("n_class")
    )
    # One map value with an entry per class: no shuffle by class, however uneven.  It is
    # counted here, once; as part of the plan every pass over the rows would count it again.
    entry = F.struct(F.col(label_col).alias("key"), F.col("weight").alias("value"))
    table = sizes.withColumn("weight", weight).agg(
        F.map_from_entries(F.collect_list(entry)).alias("weights")
    )
    weights = table.first()["weights"]
    if not weights:
        return labelled.withColumn("weight", F.lit(None).cast("double"))
    return _weighted(labelled, label_col, weights)


def _weighted(labelled: DataFrame, label_col: str, weights: dict[str, float]) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return labelled.withColumn("weight", F.element_at(known, F.col(label_col)))


def standard_scale(m: DataFrame) -> DataFrame:
    """Zero mean and unit population deviation per probe; constant probes give 0."""
    stats = m.groupBy("probe_id").agg(
        F.avg("value").alias("__mean"), F.stddev_pop("value").alias("__std")
    )
    scale = F.when(F.col("__std") > 0, F.col("__std")).otherwise(F.lit(1.0))
    return (
        m.join(stats, "probe_id")
        .withColumn("value", (F.col("value") - F.col("__mean")) / scale)
        .drop("__mean", "__std")
    )
