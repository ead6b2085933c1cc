"""Stored histograms against the log itself, compaction by date, and repeats that bring fewer dates."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callscope.operators.percentiles import hourly_values
from callscope.plans import logs as log_reports
from callscope.plans import metrics
from callscope.schemas import INFERENCE_LOG_SCHEMA
from callscope.sources import tables
from callscope.sources.tables import Warehouse

AS_OF = "2024-01-10 10:30:00"


def log_rows(spark, first, last, step_minutes=20):
    """Log rows that arrive every few minutes: lengths of many values, failures, and rows without a length or rate."""
    n = F.col("id")
    given = {
        "event_id": F.format_string("e%06d", n),
        "provider": F.lit("p"),
        "model": F.concat(F.lit("m"), (n % 2).cast("string")),
        "status": F.when(n % 7 == 3, "error").otherwise("success"),
        "duration_ms": F.when(n % 11 != 5, n * 7919 % 200_003),
        "ttft_ms": F.when(n % 3 > 0, n % 50),
        "tokens_per_second": F.when(n % 5 > 0, n % 90 / 4),
        "created_at": F.timestamp_seconds(F.lit(1_704_585_600) + n * step_minutes * 60),  # from 2024-01-07 on
        "completed_at": F.timestamp_seconds(F.lit(1_704_585_600) + n * step_minutes * 60),
    }
    columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INFERENCE_LOG_SCHEMA.fields]
    return spark.createDataFrame(spark.range(first, last).select(*columns).collect(), INFERENCE_LOG_SCHEMA)


def store(warehouse, rows, n, values=True):
    stored = warehouse.append_logs(rows, n)
    warehouse.add_to_rollup(stored, n)
    if values:
        warehouse.add_values(stored, n)
    warehouse.write("ingest_batches", rows.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("input_rows", "accepted_rows", "rejected_rows", "duplicate_rows")]), n)


def held(df, *leave):
    return sorted(map(str, df.drop(*leave).collect()))


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "wh"))


def check_windows(warehouse):
    logs = warehouse.logs()
    for window, as_of in (("1h", AS_OF), ("45m", "2024-01-10 10:00:00"), ("24h", AS_OF), ("7d", AS_OF), ("1h", "2025-01-01 00:00:00")):
        assert metrics.percentiles_of(warehouse.values(window, as_of)).collect() == metrics.percentiles(logs, window, as_of).collect()
        newest = log_reports.recent_logs(warehouse.newest_logs(20, window, as_of), 20)
        assert newest.collect() == log_reports.recent_logs(metrics.log_window(logs, window, as_of), 20).collect()


def test_values_equal_the_log(spark, warehouse):
    store(warehouse, log_rows(spark, 0, 130), 0, values=False)  # a log from before there were histograms
    store(warehouse, log_rows(spark, 130, 200), 1)
    store(warehouse, log_rows(spark, 130, 200), 1)  # a repeat
    assert tables.listed(spark, f"{warehouse.path('value_histograms')}/_begun")  # so the log is read this once
    store(warehouse, log_rows(spark, 200, 245), 2)
    check_windows(warehouse)
    plan = warehouse.values("7d", "2024-01-16 00:30:00")._jdf.queryExecution().optimizedPlan().toString()
    assert "created_at" in plan  # the edge hour only
    files = warehouse.values("7d", "2024-01-15 12:30:00").inputFiles()
    assert {f.split("ingest_date=")[1][:10] for f in files if "inference_logs" in f} == {"2024-01-08"}


def test_empty_values(spark, warehouse):
    row = metrics.percentiles_of(warehouse.values("24h", AS_OF)).collect()[0]
    assert row["sample_size"] == 0 and row["dur_p50"] is None
    assert hourly_values(log_rows(spark, 0, 1).limit(0)).count() == 0
    assert warehouse.newest_logs(5, "24h", AS_OF).count() == 0


def test_compaction_while_batches_come(spark, warehouse, monkeypatch):
    for n in range(3):
        store(warehouse, log_rows(spark, n * 60, n * 60 + 90 if n < 2 else 180), n)  # the dates overlap
    contents = lambda: [held(warehouse.logs(), "batch"), held(warehouse.rollup()), held(warehouse.values())]
    before = contents()

    def same():
        for got, want in zip(contents(), before, strict=True):
            assert got == want
        return True


    with monkeypatch.context() as patch:  # dies with its piece written, before the manifest
        patch.setattr(tables, "put_once", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            warehouse.compact_date("inference_logs", "2024-01-08")
    assert same() and warehouse._pieces("inference_logs") == {}

    late = log_rows(spark, 30, 31).withColumn("event_id", F.lit("late"))
    put = tables.put_once
    with monkeypatch.context() as patch:  # a batch comes to the same date while the piece is written
        patch.setattr(tables, "put_once", lambda *a: (store(warehouse, late, 3), put(*a))[1])
        assert warehouse.compact_date("inference_logs", "2024-01-07")
    before = contents()
    assert any("late" in row for row in before[0])
    assert set(warehouse._pieces("inference_logs")["2024-01-07"]["covers"]) == {"main-0", "main-1"}

    with monkeypatch.context() as patch:  # another compaction was first
        patch.setattr(tables, "put_once", lambda *_: False)
        with pytest.raises(tables.LostCompaction):
            warehouse.compact_date("value_histograms", "2024-01-07")
    warehouse.compact_closed("2024-01-09")
    assert same()
    store(warehouse, late, 3)  # the newest batch may run again: it isn't in any piece
    assert same()
    store(warehouse, late.limit(0), 4)
    warehouse.compact_closed("2024-01-09")  # now it is
    assert "main-3" in warehouse._pieces("inference_logs")["2024-01-07"]["covers"] and same()
    for table in ("inference_logs", "aggregated_metrics", "value_histograms"):
        warehouse.drop_covered(table)
    assert same()
    assert not warehouse.compact_date("inference_logs", "2024-01-07")
    check_windows(warehouse)
    # Rows of a piece are replaced in the piece.
    warehouse.replace_folders("inference_logs", warehouse.logs().withColumn("provider", F.lit("q")), "ingest_date")
    assert {r["provider"] for r in warehouse.logs().select("provider").distinct().collect()} == {"q"}
    assert warehouse.logs().count() == len(before[0])


def test_repeat_with_fewer_dates(spark, warehouse):
    store(warehouse, log_rows(spark, 0, 150), 0)
    store(warehouse, log_rows(spark, 0, 5), 0)
    assert warehouse.logs().count() == 5
    assert warehouse.rollup().agg(F.sum("request_count")).collect()[0][0] == 5
    assert warehouse.values().where("measure = 'arrival'").collect()[0]["n"] == 5
    store(warehouse, log_rows(spark, 0, 0), 0)
    assert warehouse.logs().count() == 0
