"""Fan-out of a micro-batch to several sinks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.plans.logs import recent_buffer

Sink = Callable[[DataFrame, int], None]


class Backlog:
    """Batches that sinks have missed, kept under `root` until every sink has them.

    A batch's rows are stored once, before a marker file names the sink that lacks them.  The marker goes after the
    sink has taken the batch, so a crash at any point only gives a sink a batch once more.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _markers(self, sink: str, batch: str = "*") -> list[int]:
        path, system = self._at("missed", sink, f"batch={batch}")
        return sorted(int(found.getPath().getName().split("=")[1]) for found in system.globStatus(path) or [])

    def missed(self, sink: str, before: int) -> list[int]:
        return [batch_id for batch_id in self._markers(sink) if batch_id < before]

    def rows(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows/batch={batch_id}")

    def keep(self, sinks: Sequence[str], batch: DataFrame, batch_id: int) -> None:
        if sinks:
            batch.write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch_id}")
        for sink in sinks:
            path, system = self._at("missed", sink, f"batch={batch_id}")
            system.create(path, True).close()

    def taken(self, sink: str, batch_id: int) -> None:
        path, system = self._at("missed", sink, f"batch={batch_id}")
        if system.delete(path, False) and not self._markers("*", str(batch_id)):
            path, system = self._at("rows", f"batch={batch_id}")
            system.delete(path, True)


def fan_out(sinks: Mapping[str, Sink], report_path: str | None = None, backlog: str | None = None) -> Sink:
    """One `foreachBatch` function for many sinks; a failing sink leaves the others alone.

    The batch is computed once.  Outcomes go to `report_path`, one row per sink and batch that it was given.
    With a `backlog` folder, a sink that failed gets the batches that it missed, in order, before the next one; until
    it takes them, later batches wait there too.  Sinks must replace a batch that they get again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        late = Backlog(batch.sparkSession, backlog) if backlog else None
        batch.persist()
        outcomes, failed = [], []
        try:
            for name, sink in sinks.items():
                now = batch_id
                try:
                    for now in late.missed(name, batch_id) if late else ():
                        sink(late.rows(now), now)
                        late.taken(name, now)
                        outcomes.append((now, name, True, None))
                    now = batch_id
                    sink(batch, batch_id)
                    outcomes.append((batch_id, name, True, None))
                except Exception as failure:  # noqa: BLE001 - any sink failure is only reported
                    failed.append(name)
                    outcomes.append((now, name, False, str(failure)))
                else:
                    if late:
                        late.taken(name, batch_id)
            if late:
                late.keep(failed, batch, batch_id)
        finally:
            batch.unpersist()
        if report_path:
            report = batch.sparkSession.createDataFrame(
                outcomes, "batch_id long, sink string, ok boolean, error string"
            )
            report.write.mode("overwrite").parquet(f"{report_path}/batch={batch_id}")

    return write


def parquet_sink(path: str) -> Sink:
    """Append-by-batch Parquet: a repeated batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def json_sink(path: str) -> Sink:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


def recent_sink(path: str, size: int = 200) -> Sink:
    """Keep the newest `size` events: old buffer and batch in, top rows out.

    Two folders take turns, so the buffer being read is never the one being replaced.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamped = batch.withColumn("emitted_at", F.current_timestamp())
        if batch_id > 0:
            before = spark.read.parquet(f"{path}/side={(batch_id - 1) % 2}")
            stamped = stamped.unionByName(before, allowMissingColumns=True)
        recent_buffer(stamped, size).write.mode("overwrite").parquet(f"{path}/side={batch_id % 2}")

    return write
