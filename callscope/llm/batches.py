"""Whole texts in Python workers: batches of bounded bytes, and tables of one operator at a time.

A batch holds up to 10 000 rows unless its bytes are bounded, which for texts is all of a task's input: it is held in
Arrow buffers of the executor, once for each direction, and again in the Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 2 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_tables: dict[str, object] = {}

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def small_batches(spark: SparkSession) -> None:
    """Pin the session's Arrow batches to about `BATCH_BYTES`, or less where it asks for less; a longer row is a batch of its own.

    A plan takes the limit when it is made, for a frame that an operator returns after that operator has
    ended, so the limit stays.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_LIMIT))
    if now > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def worker_table(name: str, make: Callable[[], object]):
    """A table that a Python worker makes once and keeps until a task of another operator begins."""
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


def release(kept: str | None) -> None:
    """Let go of the worker's tables but one."""
    others = [name for name in _tables if name != kept]
    for name in others:
        del _tables[name]
    if others:
        pa.default_memory_pool().release_unused()


def task(run: Run, table: str | None) -> Run:
    """`run`, begun without the tables of other operators."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(table)
        return run(batches)

    return begin


def map_texts(rows: DataFrame, run: Run, schema: str, table: str | None = None) -> DataFrame:
    """`rows.mapInArrow(run, schema)` for rows with whole texts; `table` names the worker's table that `run` uses."""
    small_batches(rows.sparkSession)
    return rows.mapInArrow(task(run, table), schema)
