"""Session construction and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

# Settings every job relies on.  Sizes follow data volume through AQE; nothing here
# depends on the machine the job runs on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

STATE_STORE = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app_name: str = "callscope", master: str | None = None, **conf) -> SparkSession:
    """Create (or fetch) a session with the runtime settings; `conf` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: event hours are UTC hours."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside run plans in methods that Java compiles to machine code.

    It interprets methods of more than 8000 bytes for good.  A stage over many columns, fused into one method, is longer
    and several times slower; with this limit Spark runs such a stage operator by operator.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "8000")
    try:
        yield
    finally:
        spark.conf.set(limit, before)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's `spark.checkpoint.dir`, or the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder that goes when the process
    ends; on a cluster executors could not share one, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_scratch().name
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@cache
def _local_scratch() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="callscope-", ignore_cleanup_errors=True)
