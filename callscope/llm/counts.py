"""Sums of equally long count arrays that many tasks hand over in a fixed number of parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 64
LANES = 32
SCHEMA = "part int, counts array<long>"


def in_parts(counts: np.ndarray) -> pa.RecordBatch:
    """A task's counts (rows of a multiple of PARTS buckets) as one row per part."""
    parts = counts.reshape(len(counts), PARTS, -1).transpose(1, 0, 2).reshape(PARTS, -1)
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(list(parts), pa.list_(pa.int64()))], ["part", "counts"])


def _add(key, frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(frame["counts"].iloc[0]), np.int64)
    for counts in frame["counts"]:
        total += counts
    return pd.DataFrame({"part": [key[0]], "counts": [total]})


def summed(parts: DataFrame, rows: int, buckets: int) -> np.ndarray:
    """All tasks' counts, added up in two levels; rows * buckets numbers come to the driver."""
    near = parts.withColumn("lane", F.pmod(F.hash(F.spark_partition_id()), F.lit(LANES))).groupBy("part", "lane").applyInPandas(_add, SCHEMA)
    total = np.zeros((rows, PARTS, buckets // PARTS), np.int64)
    for row in near.groupBy("part").applyInPandas(_add, SCHEMA).collect():
        total[:, row["part"], :] = np.array(row["counts"]).reshape(rows, -1)
    return total.reshape(rows, buckets)
