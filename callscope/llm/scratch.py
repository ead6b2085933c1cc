"""Intermediate tables of an operator in the shared scratch folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from callscope.session import scratch_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs started within give their shuffle files back as soon as they are done."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables written as Parquet, which cuts lineage and outlives executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.made = spark, scratch_dir(spark, label), 0

    def keep(self, frame: DataFrame) -> DataFrame:
        """The table, written and read again."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        with shuffles_freed(self.spark):
            frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables; everything that reads them must be stored by now."""
        for table in tables:
            files = table.inputFiles()
            if not files:
                continue
            folder = files[0].rsplit("/", 1)[0]
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            if not folder.split(":", 1)[-1].lstrip("/").startswith(self.root.split(":", 1)[-1].lstrip("/")):
                raise ValueError(f"{folder} is no table of {self.root}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
