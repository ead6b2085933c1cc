"""Vectors as exact whole numbers inside Arrow tasks, and sums of them that can't overflow unseen."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SMALL = 2.0**40
_ROOM = 1 << 62
SLICE = 2048


def sound(vector: str):
    """Whether a vector is there and all its components are there and finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def fitting(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The sound rows whose vector has the commonest length (the longest of equally common ones), and that length."""
    good = rows.where(sound(vector))
    top = good.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = top["size"] if top else 0
    return good.where(F.size(vector) == size), size


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as 64-bit numbers, or as Python numbers where some are large.  `scale` is a power of 2."""
    if not values.size or np.abs(values).max() < _SMALL:
        return np.floor(values * scale).astype(np.int64)
    return np.frompyfunc(lambda x: int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale), 1, 1)(values)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), SLICE):
            yield batch.slice(start, SLICE)


def wide(values: np.ndarray, growth: int) -> np.ndarray:
    """The numbers as they are where `growth` times their largest square fits 64 bits, else as Python numbers."""
    if values.dtype == object or not values.size:
        return values
    top = max(abs(int(values.max())), abs(int(values.min())))
    return values if top * top * growth < _ROOM else values.astype(object)


def decimals(numbers) -> pa.Array:
    return pa.array([int(x) for x in numbers], pa.decimal128(38, 0))
