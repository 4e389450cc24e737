"""Principal components of sample arrays without a probe-by-probe matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Directions carried beside the wanted ones; more of them settle in fewer passes.
SPARE = 8
#: Blocks of directions kept before the basis is cut back to the best block.
BLOCKS = 6
#: Bytes of one batch of arrays in a task.
_BATCH_BYTES = 64 << 20
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass
class Components:
    """Means, unit directions (one column each) and variances, largest variance first."""

    means: np.ndarray
    directions: np.ndarray
    variances: np.ndarray

    def coordinate(self, values: Column, number: int) -> Column:
        """The centred coordinate of an array along one direction, in the JVM."""
        direction = self.directions[:, number]
        # One text in the plan, folded to an array, however many the probes.
        text = ",".join(map(repr, direction.tolist()))
        weights = F.split(F.lit(text), ",").cast("array<double>")
        terms = F.zip_with(values, weights, lambda v, w: v * w)
        total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
        return total - F.lit(float(self.means @ direction))


def _summed(
    arrays: DataFrame, size: int, width: int, part: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """Sum over all batches of ``part`` (size x width): added up per task, then per place."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width))
        for batch in batches:
            total += part(np.asarray(batch.column(0).flatten()).reshape(-1, size))
        columns = [pa.array(np.arange(size, dtype=np.int32))]
        columns += [pa.array(total[:, i]) for i in range(width)]
        yield pa.RecordBatch.from_arrays(columns, ["place", *names])

    names = [f"s{i}" for i in range(width)]
    schema = ", ".join(["place int", *[f"{n} double" for n in names]])
    spark = arrays.sparkSession
    before = spark.conf.get(_RECORDS)
    spark.conf.set(_RECORDS, str(max(1, min(10_000, _BATCH_BYTES // (8 * size)))))
    try:
        rows = arrays.mapInArrow(totals, schema).groupBy("place")
        found = rows.agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    finally:
        spark.conf.set(_RECORDS, before)
    return found.sort_values("place")[names].to_numpy()


def _fresh(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit directions of the block outside the basis; what the basis holds drops out."""
    lengths = np.linalg.norm(block, axis=0)
    block = block[:, lengths > 0] / lengths[lengths > 0]
    for _ in range(2):  # the second pass removes what rounding left
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    return q - basis @ (basis.T @ q)


def principal_components(
    arrays: DataFrame,
    size: int,
    k: int = 3,
    tolerance: float = 1e-8,
    passes: int = 60,
    seed: int = 42,
) -> Components:
    """Leading components of ``values`` (stored arrays of ``size`` finite values).

    Randomised subspace iteration that keeps earlier blocks: a pass multiplies a narrow
    block of directions by the centred covariance on the executors, and the driver turns
    the blocks, at most ``BLOCKS`` * (k + ``SPARE``) directions of ``size`` values, into
    the best directions so far.  It ends when every wanted direction is mapped onto
    itself up to ``tolerance`` of the largest variance, or after ``passes`` passes.  The
    largest entry of a direction is positive.  Of fewer than two samples the variances
    are 0; no samples are refused.
    """
    if not 0 < k <= size:
        raise ValueError("as many components as values at most, and one at least")
    values = arrays.select(F.col("values").cast("array<double>"))
    rows = values.count()
    if rows == 0:
        raise ValueError("no samples to embed")
    means = _summed(values, size, 1, lambda x: x.sum(axis=0)[:, None])[:, 0] / rows
    context = arrays.sparkSession.sparkContext

    def covariance_times(block: np.ndarray) -> np.ndarray:
        shared = context.broadcast((means, block))  # size x width values, both bounded

        def part(x: np.ndarray) -> np.ndarray:
            centre, directions = shared.value
            x = x - centre
            return x.T @ (x @ directions)

        try:
            return _summed(values, size, block.shape[1], part) / max(rows - 1, 1)
        finally:
            shared.unpersist()

    width = min(size, k + SPARE)
    start = np.random.default_rng(seed).normal(size=(size, width))
    basis = np.linalg.qr(start)[0]
    image = covariance_times(basis)
    for step in range(1, passes + 1):
        inner = basis.T @ image
        variances, turn = np.linalg.eigh((inner + inner.T) / 2)
        best = np.argsort(variances)[::-1][:width]
        variances, turn = variances[best], turn[:, best]
        lead, lead_image = basis @ turn, image @ turn
        missed = lead_image - lead * variances
        off = np.linalg.norm(missed[:, :k], axis=0).max()
        if off <= tolerance * max(variances[0], 0.0) or step == passes:
            break
        if basis.shape[1] + width > BLOCKS * width:
            basis, image = lead, lead_image
        new = _fresh(missed, basis)
        if not new.shape[1]:
            break
        basis = np.hstack([basis, new])
        image = np.hstack([image, covariance_times(new)])
    directions = lead[:, :k]
    largest = np.abs(directions).argmax(axis=0)
    directions = directions * np.where(directions[largest, np.arange(k)] < 0, -1.0, 1.0)
    return Components(means, directions, np.maximum(variances[:k], 0.0))
