"""Small files that readers follow: listing by pattern, and putting one in place whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system that it is on."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern names; only the folders above them are listed."""
    path, system = hadoop_path(spark, pattern)
    return sorted(status.getPath().toString() for status in system.globStatus(path) or [])


def put_once(spark: SparkSession, target: str, text: str) -> bool:
    """Move a complete file into place; false if there is one already.  It is never seen half written and never replaced."""
    folder = target.rsplit("/", 1)[0]
    final, system = hadoop_path(spark, target)
    part, _ = hadoop_path(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = system.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(final) or not system.rename(part, final):
        system.delete(part, False)
        return False
    return True
