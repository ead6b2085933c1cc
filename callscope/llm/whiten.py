"""Whitening of embeddings by a covariance that is put together from variances alone.

1. Components c become whole numbers floor(1024 * c) + 100000; their sums give every dimension's mean.
2. Tasks add up exact squares of the centred values of every dimension and of the sum of every two dimensions.
   By polarisation 2 cov(x, y) = var(x + y) - var(x) - var(y), so differences of these variances are all
   covariances.  Values are centred at the whole number next to the mean, and the small rest is taken off in whole
   numbers too, so a covariance is rounded once, on division.
3. The matrix is taken apart by `eigh`; rows are projected on the first components and divided by their deviation.

Vectors that are null or hold a null or non-finite component take no part; of vectors of unequal lengths only
those of the commonest length do (the longest of equally common ones).  Repeated rows count as often as they are there,
ids may be null.  Components without variance (a table of one vector, equal dimensions) can't be whitened and
have no rows; an empty table gives none.  A sum beyond 38 digits is an error, not a wrong number.

Every task and the driver hold a matrix of (dimensions)^2 numbers, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.exact import decimals, fitting, floors, matrix, slices, wide
from callscope.session import scratch_dir

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
_TOTALS = "i int, j int, total decimal(38,0)"


@dataclass
class Fit:
    """What the fit list gives: n vectors, whole centres near the means, sums of centred values, and the components."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole(column: pa.Array) -> np.ndarray:
    return floors(matrix(column), SCALE) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = 0, 0
    for batch in slices(batches):
        total = total + wide(whole(batch.column(0)), len(batch)).sum(axis=0).astype(object)
        n += len(batch)
    if n:
        places = [*range(len(total)), -1]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([-1] * len(places), pa.int32()), decimals([*total, n])], ["i", "j", "total"])


def _squares(centre: np.ndarray):
    """Sums of centred values (i, -1), of their squares (i, i), and of the squares of their sums (i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(centre)
        small = np.zeros((d, d + 1), np.int64)
        large = np.zeros((d, d + 1), object)
        seen = False
        for batch in slices(batches):
            z = wide(whole(batch.column(0)) - centre, 4 * len(batch))
            part = np.zeros((d, d + 1), z.dtype)
            part[:, d] = z.sum(axis=0)
            for i in range(d):
                part[i, i] = (z[:, i] * z[:, i]).sum()
                pairs = z[:, i : i + 1] + z[:, i + 1 :]
                part[i, i + 1 : d] = (pairs * pairs).sum(axis=0)
            if z.dtype == object or max(np.abs(small).max(), np.abs(part).max()) > 1 << 61:
                large, small = large + small + part, np.zeros_like(small)
            else:
                small += part
            seen = True
        if seen:
            i, j = np.triu_indices(d, 0, d + 1)
            total = large[i, j] + small[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(np.where(j == d, -1, j).astype(np.int32)), decimals(total)], ["i", "j", "total"])

    return run


def _totals(rows: DataFrame, task) -> dict[tuple[int, int], int]:
    """The tasks' sums added up; as many numbers as `task` yields rows come to the driver."""
    return {(r["i"], r["j"]): int(r["total"]) for r in rows.mapInArrow(task, _TOTALS).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}


def covariances(n: int, totals: dict[tuple[int, int], int], d: int) -> np.ndarray:
    """The covariance matrix from variances of dimensions and of sums of two dimensions."""
    rest = [totals[i, -1] for i in range(d)]
    own = [n * totals[i, i] - rest[i] ** 2 for i in range(d)]
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = own[i] / n**2
        for j in range(i + 1, d):
            both = n * totals[i, j] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n**2)
    return out


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Fit | None:
    """Means, covariances and components of a column of vectors of length d; None without vectors."""
    sums = _totals(rows, _sums)
    if not sums or not d:
        return None
    n = sums.pop((-1, -1))
    centre = np.array([(2 * sums[i, -1] + n) // (2 * n) for i in range(d)], object)
    if max(abs(int(c)) for c in centre) < 1 << 60:
        centre = centre.astype(np.int64)
    totals = _totals(rows, _squares(centre))
    cov = covariances(n, totals, d)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * d * np.finfo(float).eps]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Fit(n, centre, np.array([totals[i, -1] for i in range(d)], object), vectors, values[order], float(np.trace(cov)))


def _project(model: Fit):
    rest = np.array([int(s) / model.n for s in model.rest])
    scaled = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            z = whole(batch.column(1)) - model.centre
            top = model.n * (max(abs(int(z.max())), abs(int(z.min()))) + 1)
            if z.dtype == object or top * top * z.shape[1] >= 1 << 62:
                y = z.astype(object) * model.n - model.rest
            else:
                y = z * model.n - model.rest.astype(np.int64)
            white = (z.astype(np.float64) - rest) @ scaled
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), decimals((y * y).sum(axis=1)), pa.array(list(white), pa.list_(pa.float64()))], ["vec_id", "deviation", "white"]
            )

    return run


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity, measured on the values themselves."""
    means = white.agg(*[F.avg(F.col("white")[a]).alias(f"m{a}") for a in range(components)]).first()
    centred = [F.col("white")[a] - F.lit(means[a]) for a in range(components)]
    places = [(a, b) for a in range(components) for b in range(a, components)]
    found = white.agg(*[F.avg(centred[a] * centred[b]).alias(f"c{a}_{b}") for a, b in places]).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(found, places, strict=True))


OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: n, the vector's exact squared deviation (times n^2), the whitened value, the
    component's share of the variance, and how far the whitened values are from an identity covariance."""
    spark = vectors.sparkSession
    rows, d = fitting(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")), "vector")
    model = fit(rows.select("vector"), d, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], OUT)
    path = scratch_dir(spark, "whitened")
    rows.mapInArrow(_project(model), "vec_id long, deviation decimal(38,0), white array<double>").write.parquet(path)
    white = spark.read.parquet(path)
    error = identity_error(white, len(model.values))
    shares = F.array(*[F.lit(float(v) / model.trace) for v in model.values])
    return white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
