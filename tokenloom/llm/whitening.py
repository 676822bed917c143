"""Embedding whitening (13) from exact variances.

Entries become integers.  Per dimension their sum gives the mean; values are centred on its whole part, and what is left of
it, a fraction with the number of vectors below, is taken off exactly at the end.  Tasks add up the squares of the centred
values of every dimension and of the sums of every two dimensions.  As a covariance is half of what the variance of a sum
exceeds the two variances by (polarisation), differences of these totals, in whole numbers of any size, give all covariances
without rounding; only then do they become doubles, and the driver solves a matrix as large as the dimension.

Each task emits one row per pair of dimensions, cut into limbs of 32 bits so that sums of longs stay exact; vectors never move.  The
dimension is that of most vectors (the larger of two as frequent) and at most ``DIMENSIONS``.

Defined cases: null vectors, vectors with null or non-finite entries, or entries that no long can hold 64 times, and vectors
of another dimension are dropped; null ids stay; repeated rows are rows of their own; components whose eigenvalue is not above
``LEAST`` of the first (of constant or dependent dimensions, or of a single vector) can't be whitened and are left out; of the
two signs of a component its largest entry, the first of equals, is positive; a deviation of 2^124 or more is null, and in the report
one that no long can hold; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000      # of the integers: floor(SCALE * entry) + SHIFT
DIMENSIONS = 2048                 # bounds what the driver holds: a row per pair of dimensions
COMPONENTS = 32
LEAST = 1e-11
ROWS = 2048                       # vectors of an array operation
LIMBS = 5                         # of 32 bits: totals below 2^159
SAFE = 1 << 62


def integers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``_id`` and ``x`` of the vectors that can be used."""
    rows = vectors.select(F.col(id_column).alias("_id"), F.col(vector_column).cast("array<double>").alias("_v"))
    good = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float(SAFE)))
    return rows.where(F.col("_v").isNotNull() & good).select("_id", F.transform("_v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integers of some vectors at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), part.column(part.num_columns - 1).flatten().to_numpy().reshape(-1, size)


def fitting(values: np.ndarray, most: int) -> np.ndarray:
    """The integers as they are if results up to ``most`` fit 64 bits, else as whole numbers of any size."""
    return values if most < SAFE else values.astype(object)


def largest(values: np.ndarray) -> int:
    return int(max(abs(int(values.max())), abs(int(values.min())))) if values.size else 0


def limbs(total: int) -> list[int]:
    """32 bits each, lowest first; the last one has the sign."""
    return [total >> 32 * k & 0xFFFFFFFF for k in range(LIMBS - 1)] + [total >> 32 * (LIMBS - 1)]


_LIMBS = ", ".join(f"l{k} bigint" for k in range(LIMBS))


def _totals(rows: DataFrame, size: int, values: int, add: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Totals over all vectors of as many ``values`` that ``add`` gives for some of them, exact."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(values, object)
        for _, x in _matrices(batches, size):
            held = held + add(x)
        cut = list(zip(*map(limbs, held.tolist())))
        yield pa.record_batch({"number": pa.array(range(values), pa.int32())} | {f"l{k}": pa.array(v, pa.int64()) for k, v in enumerate(cut)})

    parts = rows.select("x").mapInArrow(task, f"number int, {_LIMBS}")
    summed = parts.groupBy("number").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).toArrow()
    out = [0] * values
    for row in summed.to_pylist():
        out[row["number"]] = sum(row[f"l{k}"] << 32 * k for k in range(LIMBS))
    return out


def column_sums(x: np.ndarray) -> np.ndarray:
    return fitting(x, largest(x) * len(x)).sum(axis=0)


def pair_squares(y: np.ndarray) -> np.ndarray:
    """Row by row of the upper triangle: the sum of squares of a dimension, then of its sums with each later one."""
    y = fitting(y, (2 * largest(y)) ** 2 * len(y))
    return np.concatenate([np.r_[(y[:, i] ** 2).sum(), ((y[:, i:i + 1] + y[:, i + 1:]) ** 2).sum(axis=0)] for i in range(y.shape[1])])


@dataclass
class Whitening:
    """What was learned: ``n`` vectors; of each dimension the mean, whole part and rest over n; ``axes`` has the components by
    column, divided by the root of their eigenvalue."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each vector the sum of squares of n * x - S."""
        y = x - self.whole
        scaled = fitting(y, self.n * (largest(y) + 1)) * self.n - self.rest
        return (fitting(scaled, largest(scaled) ** 2 * max(scaled.shape[1], 1)) ** 2).sum(axis=1).tolist()


def polarised(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """The covariance matrix; every entry is one division of whole numbers."""
    size = len(rest)
    first = np.cumsum([0, *range(size, 0, -1)])
    own = [n * squares[first[i]] - rest[i] ** 2 for i in range(size)]                 # n squared times the variance
    out = np.zeros((size, size))
    for i in range(size):
        out[i, i] = own[i] / n ** 2
        for j in range(i + 1, size):
            both = n * squares[first[i] + j - i] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n ** 2)
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """What the vectors of the usual dimension teach, and these vectors."""
    usual = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if usual is None or not usual["size"]:
        return None, rows.limit(0)
    size = usual["size"]
    if size > DIMENSIONS:
        raise ValueError(f"more than {DIMENSIONS} dimensions")
    n, rows = usual["count"], rows.where(F.size("x") == size)
    sums = _totals(rows, size, size, column_sums)
    whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    squares = _totals(rows, size, size * (size + 1) // 2, lambda x: pair_squares(x - whole))
    covariance = polarised(n, rest, squares)
    values, vectors = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > LEAST * max(values.max(), 0)]
    vectors = vectors[:, order] * np.where(
        np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)[order]
    trace = covariance.trace()
    return Whitening(n, whole, np.array(rest, np.int64), covariance, values[order], vectors / np.sqrt(values[order]),
                     values[order] / trace if trace else values[order]), rows


def identity_error(spark: SparkSession, rows: DataFrame, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened vectors differs from the identity.

    Projections of centred vectors have mean zero; what rounding leaves of it is taken off all the same.
    """
    size, wide = len(model.whole), model.axes.shape[1]
    shared = spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((wide + 1, wide))
        for _, x in _matrices(batches, size):
            w = shared.value.whitened(x)
            held += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.record_batch({"number": pa.array(range(held.size), pa.int32()), "total": pa.array(held.ravel())})

    out = np.zeros((wide + 1) * wide)
    for row in rows.select("x").mapInArrow(task, "number int, total double").groupBy("number").agg(F.sum("total").alias("total")).collect():
        out[row["number"]] = row["total"]
    products, mean = out[:-wide].reshape(wide, wide) / model.n, out[-wide:] / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(wide)).max()) if wide else 0.0


def projected(spark: SparkSession, rows: DataFrame, model: Whitening) -> DataFrame:
    """``_id``, ``deviation`` (below 2^124) and ``whitened``, an array by component."""
    size, shared = len(model.whole), spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, size):
            own, far = shared.value.whitened(x), shared.value.deviations(x)
            ends = pa.array(np.arange(len(x) + 1) * own.shape[1], pa.int32())
            high, low = zip(*(divmod(v, SAFE) if v < SAFE * SAFE else (None, None) for v in far)) if far else ((), ())
            yield pa.record_batch({"_id": ids, "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64()),
                                   "whitened": pa.ListArray.from_arrays(ends, pa.array(own.ravel()))})

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(task, f"_id {kind}, high bigint, low bigint, whitened array<double>")
    deviation: Column = F.col("high").cast("decimal(19,0)") * F.lit(SAFE).cast("decimal(19,0)") + F.col("low")
    return found.select("_id", deviation.cast("decimal(38,0)").alias("deviation"), "whitened")


REPORT = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def report(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """One row per vector and component."""
    rows = integers(vectors, id_column, vector_column)
    model, rows = fit(rows, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], REPORT.format(rows.schema["_id"].dataType.simpleString()))
    found = projected(spark, rows, model)
    each = found.select("_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        F.col("_id").alias("vec_id"), (F.col("place") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        F.element_at(F.array(*(F.lit(float(e)) for e in model.explained)), F.col("place") + 1).alias("explained"),
        F.lit(identity_error(spark, rows, model)).alias("identity_error"))
