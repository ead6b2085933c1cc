"""Table scans and the stored tables that ingest writes and reports read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.timing import hour_bucket, window_start
from callscope.operators.percentiles import ARRIVAL, hourly_values, latency_sketches, measured, merge_sketches, merge_values, value_histogram
from callscope.operators.rollup import hourly_rollup, merge_rollups
from callscope.schemas import INFERENCE_LOG_SCHEMA, ROLLUP_KEYS, ROLLUP_SCHEMA, struct_of
from callscope.session import scratch_dir
from callscope.sources.files import hadoop_path, listed, put_once
from callscope.sources.id_index import IdIndex

_BATCH = T.StructField("batch", T.StringType())
_SKETCH_SCHEMA = struct_of("hour_bucket timestamp, provider string, model string, n long").add("sketch", T.BinaryType())
_VALUE_SCHEMA = struct_of("arrival_hour timestamp, measure string, v long, n long")


class LostCompaction(RuntimeError):
    """Another compaction has put its piece of this date in place."""


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan with every zone-less timestamp read as UTC."""
    df = spark.read.parquet(path)
    return df.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name)
            if f.dataType.typeName() == "timestamp_ntz"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A batch-partitioned table; one that was never written reads as empty."""
    full = T.StructType([*schema.fields, _BATCH])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


class Warehouse:
    """Raw log, rollup, dead letters and batch counts under one root folder.

    Every ingest batch owns the `batch=<run>-<n>` folders of its tables and rewrites them whole, so a
    batch that runs again after a failure replaces its first attempt in every table.  The log lies
    under its ingest dates and the rollup under its hour dates, batches inside; a windowed read
    lists only the dates that it needs.  A batch's ingest time is stored before its rows, so that
    a repeat writes to the same dates.  The rollup holds sums per batch and a read adds them up.

    `run` names one checkpoint's lifetime: its batch numbers start at 0, so a new checkpoint on
    the same tables needs a new run name.
    """

    def __init__(self, spark: SparkSession, root: str, run: str = "main"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.run = run

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def batch_key(self, batch_id: int) -> str:
        return f"{self.run}-{batch_id}"

    def write(self, table: str, df: DataFrame, batch_id: int, split_by: str | None = None) -> None:
        """Replace the batch's folders of a table, also those of dates that this try has no rows for."""
        key = self.batch_key(batch_id)
        if split_by is None:
            df.write.mode("overwrite").parquet(f"{self.path(table)}/batch={key}")
            return
        files = f"{self.path(table)}/{split_by}=*/batch={key}/*.parquet"
        before = set(listed(self.spark, files))
        writer = df.withColumn("batch", F.lit(key)).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(split_by, "batch").parquet(self.path(table))
        for left in before & set(listed(self.spark, files)) if before else ():
            path, system = hadoop_path(self.spark, left)
            system.delete(path, False)

    def event_ids(self) -> IdIndex:
        """The index of the log's event ids."""
        return IdIndex(self.spark, self.path("event_ids"))

    def replace_folders(self, table: str, rows: DataFrame, split_by: str) -> None:
        """Replace the folders (date and batch) that the rows name, which may have been read from these very folders.

        The rows are stored aside first, so a job that dies while folders are replaced can be repeated from them.
        Not while the same table is compacted.
        """
        aside = scratch_dir(self.spark, f"{table}-folders")
        rows.write.parquet(aside)
        stored = self.spark.read.schema(rows.schema).parquet(aside)
        piece = F.col("batch").startswith(_PIECE)
        for part, root in ((stored.where(~piece), self.path(table)), (stored.where(piece), self._compacted(table))):
            if root == self.path(table) or listed(self.spark, f"{root}/manifests/*.json"):
                writer = part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                writer.partitionBy(split_by, "batch").parquet(root)

    def batch_time(self, batch_id: int) -> datetime:
        """When the batch was first tried."""
        path = f"{self.path('batch_times')}/batch={self.batch_key(batch_id)}"
        if not listed(self.spark, f"{path}/_SUCCESS"):
            self.spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("at timestamp").parquet(path).first()["at"]

    def _compacted(self, table: str) -> str:
        return f"{self.root}/compacted/{table}"

    def _pieces(self, table: str) -> dict[str, dict]:
        """By date, the compacted piece that readers take, the batches that it covers and its version."""
        newest = {}
        for path in listed(self.spark, f"{self._compacted(table)}/manifests/*.json"):
            day, version, _ = path.rsplit("/", 1)[1].rsplit(".", 2)
            newest[day] = (int(version), path)
        if not newest:
            return {}
        texts = self.spark.read.text([path for _, path in newest.values()], wholetext=True).collect()
        held = [json.loads(r["value"]) for r in texts]
        return {h["date"]: {**h, "version": newest[h["date"]][0]} for h in held}

    def _dated(self, table: str, schema: T.StructType, split_by: str, since=None, until=None, batch: str | None = None) -> DataFrame:
        """A table by date and batch; `since` and `until` (date columns) and `batch` restrict what is listed.

        Batches that a date's compacted piece covers are read from the piece.
        """
        full = T.StructType([*schema.fields, T.StructField(split_by, T.DateType()), _BATCH])
        root, base = self.path(table), self._compacted(table)
        bounds = {k: c.cast("string") for k, c in (("since", since), ("until", until)) if c is not None}
        at = self.spark.range(1).select(*[c.alias(k) for k, c in bounds.items()]).first().asDict() if bounds else {}
        inside = lambda day: at.get("since", day) <= day <= at.get("until", day)
        pieces = {} if batch else {day: p for day, p in self._pieces(table).items() if inside(day)}
        paths = []
        for path in listed(self.spark, f"{root}/{split_by}=*" + (f"/batch={batch}" if batch else "")):
            day = path.split(f"/{split_by}=")[1].split("/")[0]
            if day in pieces:
                covered = set(pieces[day]["covers"])
                paths += [p for p in listed(self.spark, f"{path}/batch=*") if p.rsplit("/batch=", 1)[1] not in covered]
            elif inside(day):
                paths.append(path)
        out = self.spark.read.option("basePath", root).schema(full).parquet(*paths) if paths else self.spark.createDataFrame([], full)
        if pieces:
            named = [f"{base}/{split_by}={day}/batch={p['piece']}" for day, p in pieces.items()]
            out = out.unionByName(self.spark.read.option("basePath", base).schema(full).parquet(*named))
        return out

    # Reads

    def logs(self, window: str | None = None, as_of=None) -> DataFrame:
        """The raw log; a window on arrival also prunes the ingest-date folders."""
        if window is None:
            return self._dated("inference_logs", INFERENCE_LOG_SCHEMA, "ingest_date")
        start = window_start(window, as_of)
        table = self._dated("inference_logs", INFERENCE_LOG_SCHEMA, "ingest_date", F.to_date(start))
        return table.where(
            (F.col("ingest_date") >= F.to_date(start)) & (F.col("created_at") > start)
        )

    def rollup(self, window: str | None = None, as_of=None) -> DataFrame:
        """The hourly rollup, batches added up; a window prunes the hour-date folders."""
        return merge_rollups(self._hours("aggregated_metrics", ROLLUP_SCHEMA, window, as_of).select(*ROLLUP_SCHEMA.names))

    def _hours(self, table: str, schema: T.StructType, window: str | None, as_of) -> DataFrame:
        if window is None:
            return self._dated(table, schema, "bucket_date")
        start = window_start(window, as_of)
        rows = self._dated(table, schema, "bucket_date", F.to_date(start))
        return rows.where((F.col("bucket_date") >= F.to_date(start)) & (F.col("hour_bucket") > start))

    def sketches(self, window: str | None = None, as_of=None) -> DataFrame:
        """Latency sketches per hour, provider and model, batches merged; windowed like the
        rollup.  Merge them further for percentiles over wide windows without raw rows."""
        return merge_sketches(self._hours("latency_sketches", _SKETCH_SCHEMA, window, as_of), ROLLUP_KEYS)

    def values(self, window: str | None = None, as_of=None) -> DataFrame:
        """Exact histograms by measure (measure, v, n, b) of what arrived in the window, for `metrics.percentiles_of`.

        Whole hours come from the stored histograms; only the hour that the window begins in is counted in the log,
        from that hour's date alone.
        """
        if window is None:
            return merge_values(self._dated("value_histograms", _VALUE_SCHEMA, "arrival_date"), ["measure"])
        # One moment for the folders and the rows, also where it is the clock's.
        micros = self.spark.range(1).select(F.unix_micros(window_start(window, as_of))).first()[0]
        start = F.timestamp_micros(F.lit(micros))
        hour, day = hour_bucket(start), F.to_date(start)
        whole = self._dated("value_histograms", _VALUE_SCHEMA, "arrival_date", day).where((F.col("arrival_date") >= day) & (F.col("arrival_hour") > hour))
        log = self._dated("inference_logs", INFERENCE_LOG_SCHEMA, "ingest_date", day, day)
        edge = log.where((F.col("ingest_date") == day) & (F.col("created_at") > start) & (F.col("created_at") < hour + F.expr("INTERVAL 1 HOUR")))
        shares = value_histogram(measured(edge), "x", ["measure"])
        return merge_values(whole.where(F.col("measure") != ARRIVAL).select("measure", "v", "n").unionByName(shares.drop("b")), ["measure"])

    def newest_logs(self, n: int, window: str, as_of=None) -> DataFrame:
        """The window's rows of the latest hours that hold at least n rows, or all of it: enough for the n newest.

        Arrivals by hour say where these hours begin, so older dates aren't read.
        """
        start = window_start(window, as_of)
        hours = self._dated("value_histograms", _VALUE_SCHEMA, "arrival_date", F.to_date(start)).where(F.col("measure") == ARRIVAL)
        counted = hours.groupBy("arrival_hour").agg(F.sum("n").alias("n"))
        newest = counted.orderBy(F.col("arrival_hour").desc()).limit(n)  # each hour has a row, so n are enough
        held = 0
        for hour, arrived in newest.select(F.unix_micros("arrival_hour"), "n").collect():
            held += arrived
            if held >= n:
                begin = F.greatest(start, F.timestamp_micros(F.lit(hour)))
                rows = self._dated("inference_logs", INFERENCE_LOG_SCHEMA, "ingest_date", F.to_date(begin))
                late = (F.col("ingest_date") >= F.to_date(begin)) & (F.col("created_at") > start) & (F.col("created_at") >= begin)
                return rows.where(late)
        return self.logs(window, as_of)

    def dead_letters(self) -> DataFrame:
        schema = struct_of("payload string, reject_reason string")
        return _stored(self.spark, self.path("dead_letters"), schema)

    def batches(self) -> DataFrame:
        schema = struct_of(
            "input_rows long, accepted_rows long, rejected_rows long, duplicate_rows long"
        )
        return _stored(self.spark, self.path("ingest_batches"), schema)

    # Writes

    def append_logs(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Store a batch's log rows and return them as stored."""
        dated = rows.withColumn("ingest_date", F.to_date("created_at"))
        self.write("inference_logs", dated, batch_id, "ingest_date")
        stored = self._dated("inference_logs", INFERENCE_LOG_SCHEMA, "ingest_date", batch=self.batch_key(batch_id))
        return stored.select(*INFERENCE_LOG_SCHEMA.names)

    def add_to_rollup(self, stored_rows: DataFrame, batch_id: int) -> None:
        """Store the batch's share of the rollup, computed from its stored rows."""
        share = hourly_rollup(stored_rows)
        dated = share.withColumn("bucket_date", F.to_date("hour_bucket"))
        self.write("aggregated_metrics", dated, batch_id, "bucket_date")

    def add_sketches(self, stored_rows: DataFrame, batch_id: int) -> None:
        """Store the batch's latency sketches next to its rollup share."""
        hourly = stored_rows.where(F.col("completed_at").isNotNull()).withColumn(
            "hour_bucket", hour_bucket(F.col("completed_at"))
        )
        share = latency_sketches(hourly, ROLLUP_KEYS)
        dated = share.withColumn("bucket_date", F.to_date("hour_bucket"))
        self.write("latency_sketches", dated, batch_id, "bucket_date")

    def add_values(self, stored_rows: DataFrame, batch_id: int) -> None:
        """Store the batch's histograms by hour of arrival; a log without any gets those of its other batches first."""
        root = self.path("value_histograms")
        by_date = lambda rows: rows.withColumn("arrival_date", F.to_date("arrival_hour"))
        # Dynamic overwriting leaves no mark of its own.
        if not listed(self.spark, f"{root}/_begun"):
            others = self.logs().where(F.col("batch") != self.batch_key(batch_id))
            writer = by_date(hourly_values(others, "batch")).write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy("arrival_date", "batch").parquet(root)
            put_once(self.spark, f"{root}/_begun", "")
        self.write("value_histograms", by_date(hourly_values(stored_rows)), batch_id, "arrival_date")

    # Compaction

    def settled(self) -> set[str]:
        """Batches that can't run again: each run's, but for its newest."""
        runs: dict[str, dict[int, str]] = {}
        for path in listed(self.spark, f"{self.path('ingest_batches')}/batch=*"):
            name = path.rsplit("/batch=", 1)[1]
            run, _, number = name.rpartition("-")
            runs.setdefault(run, {})[int(number)] = name
        return {name for numbers in runs.values() for n, name in numbers.items() if n != max(numbers)}

    def compact_date(self, table: str, day: date | str) -> bool:
        """Put the settled batches of one date into one piece; true if there was something to do.

        Ingest and readers go on meanwhile: the piece counts from the moment its manifest is in place, and only for the
        batches that it covers, so a batch that comes later is read beside it.  A job that dies before leaves
        the table as it was; of two at once the second fails.  Covered folders stay until `drop_covered`.
        """
        schema, split_by, merge = _COMPACTED[table]
        day, base = str(day), self._compacted(table)
        held = self._pieces(table).get(day, {"covers": [], "version": 0})
        names = {p.rsplit("/batch=", 1)[1]: p for p in listed(self.spark, f"{self.path(table)}/{split_by}={day}/batch=*")}
        fresh = sorted((set(names) & self.settled()) - set(held["covers"]))
        if not fresh or len(fresh) + ("piece" in held) < 2:
            return False
        paths = [names[name] for name in fresh] + ([f"{base}/{split_by}={day}/batch={held['piece']}"] if "piece" in held else [])
        piece = f"{_PIECE}{uuid.uuid4().hex}"
        merge(self.spark.read.schema(schema).parquet(*paths)).write.parquet(f"{base}/{split_by}={day}/batch={piece}")
        manifest = {"date": day, "piece": piece, "covers": sorted({*held["covers"], *fresh})}
        if not put_once(self.spark, f"{base}/manifests/{day}.{held['version'] + 1:09d}.json", json.dumps(manifest)):
            raise LostCompaction(f"{table} {day}")
        return True

    def compact_closed(self, before: date | str, tables: Iterable[str] | None = None) -> None:
        """Compact all dates before `before`, table by table; dates that late rows came to since are taken again.

        Dates have few tasks each, so several are compacted at once.
        """
        for table in _COMPACTED if tables is None else tables:
            split_by = _COMPACTED[table][1]
            days = [path.rsplit("=", 1)[1] for path in listed(self.spark, f"{self.path(table)}/{split_by}=*")]
            with ThreadPoolExecutor(_AT_ONCE) as pool:
                list(pool.map(lambda day: self.compact_date(table, day), [day for day in days if day < str(before)]))  # noqa: B023

    def drop_covered(self, table: str) -> None:
        """Delete folders that a piece covers and pieces that a newer one replaced, once no reader that began before is left.

        Until then covered folders keep what was deleted or detached in the piece.
        """
        split_by, base = _COMPACTED[table][1], self._compacted(table)
        for day, held in self._pieces(table).items():
            old = [f"{self.path(table)}/{split_by}={day}/batch={name}" for name in held["covers"]]
            old += [p for p in listed(self.spark, f"{base}/{split_by}={day}/batch=*") if not p.endswith(held["piece"])]
            for name in old:
                path, system = hadoop_path(self.spark, name)
                system.delete(path, True)

    def compact_into(self, root: str, batch_id: int = 0) -> Warehouse:
        """Rewrite all batches as one under a new root, for many small batches.

        The new tables go live when readers and the ingest job are pointed at `root`, so a
        failed compaction leaves the old tables as they are.
        """
        target = Warehouse(self.spark, root, run=f"{self.run}-compacted")
        logs = self.logs().select(*INFERENCE_LOG_SCHEMA.names, "ingest_date")
        target.write("inference_logs", logs.hint("rebalance", "ingest_date"), batch_id, "ingest_date")
        rollup = self.rollup().withColumn("bucket_date", F.to_date("hour_bucket"))
        target.write("aggregated_metrics", rollup, batch_id, "bucket_date")
        sketches = self.sketches().withColumn("bucket_date", F.to_date("hour_bucket"))
        target.write("latency_sketches", sketches, batch_id, "bucket_date")
        values = self._dated("value_histograms", _VALUE_SCHEMA, "arrival_date")
        target.write("value_histograms", _merged_values(values).withColumn("arrival_date", F.to_date("arrival_hour")), batch_id, "arrival_date")
        letters = self.dead_letters().select("payload", "reject_reason")
        target.write("dead_letters", letters, batch_id)
        # Counts stay per batch: one row for each, under its own name.
        self.batches().write.mode("overwrite").partitionBy("batch").parquet(target.path("ingest_batches"))
        return target


def rebuild_rollup(logs: DataFrame) -> DataFrame:
    """The rollup from the raw log alone; equals the incrementally kept one."""
    return hourly_rollup(logs)


def _merged_values(shares: DataFrame) -> DataFrame:
    return merge_values(shares, ["arrival_hour", "measure"]).drop("b")


#: Dates that are compacted side by side.
_AT_ONCE = 6
#: How the names of compacted pieces begin.
_PIECE = "piece."
#: Tables that are compacted by date: their columns, the date column, and how batches become one.
_COMPACTED: dict[str, tuple[T.StructType, str, Callable[[DataFrame], DataFrame]]] = {
    "inference_logs": (INFERENCE_LOG_SCHEMA, "ingest_date", lambda rows: rows.hint("rebalance")),
    "aggregated_metrics": (ROLLUP_SCHEMA, "bucket_date", merge_rollups),
    "latency_sketches": (_SKETCH_SCHEMA, "bucket_date", lambda rows: merge_sketches(rows, ROLLUP_KEYS)),
    "value_histograms": (_VALUE_SCHEMA, "arrival_date", _merged_values),
}
