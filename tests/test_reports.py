"""Reports, rollups, governance and conversation maintenance on hand rows."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from callscope.operators import conversations as conv
from callscope.operators import governance, matching
from callscope.operators.rollup import hourly_rollup, merge_rollups
from callscope.plans import logs as reports
from callscope.plans import metrics

LOG = (
    "event_id string, provider string, model string, completed_at timestamp, created_at timestamp, "
    "duration_ms int, ttft_ms int, tokens_per_second decimal(10,2), tokens_in int, tokens_out int, "
    "estimated_cost_usd decimal(12,8), status string, blocked boolean, block_reason string, "
    "conversation_id string"
)


def ts(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def logs(spark):
    def row(i, done, status="success", ms=100, blocked=False, cost="0.5", arrived=None, ttft=10):
        at = ts(done) if done else None
        reason = "rate_limit_exceeded" if blocked else None
        return (
            f"e{i}", "p", "m", at, ts(arrived) if arrived else at or ts("2024-01-01 10:00:00"),
            ms, ttft, Decimal("2.50"), 10, 5, Decimal(cost), status, blocked, reason, "c1",
        )

    rows = [
        row(1, "2024-01-01 10:59:59.999999"),
        row(2, "2024-01-01 11:00:00", ms=300),
        row(3, "2024-01-01 11:10:00", "error", 0, True, "0"),
        row(4, "2024-01-01 11:20:00", "cancelled", 50),
        row(5, "2024-01-01 11:30:00", "timeout", 70),
        row(6, None, ms=None),
        row(7, "2024-01-01 09:00:00", ms=1000, arrived="2024-01-01 11:45:00", ttft=None),
    ]
    return spark.createDataFrame(rows, LOG)


def test_rollup_counts(logs):
    got = {r.hour_bucket.hour: r for r in hourly_rollup(logs).select("*").collect()}
    assert sorted(got) == [9, 10, 11]
    eleven = got[11]
    # blocked counts as an error too; a timeout counts nowhere
    assert (eleven.request_count, eleven.error_count, eleven.cancelled_count) == (4, 1, 1)
    assert (eleven.blocked_count, eleven.total_latency_ms) == (1, 420)
    assert eleven.total_cost_usd == Decimal("1.50000000")


def test_merge_equals_rebuild(logs):
    early, late = logs.where("event_id < 'e4'"), logs.where("event_id >= 'e4'")
    merged = merge_rollups(hourly_rollup(early), hourly_rollup(late))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, hourly_rollup(logs).collect()))


def test_window_compares_the_hour_itself(logs):
    rollup = hourly_rollup(logs)

    def total(window, as_of):
        return metrics.overview(rollup, window, as_of).collect()[0].total_requests

    assert total("1h", "2024-01-01 11:30:00") == 4  # only the 11:00 hour
    assert total("15m", "2024-01-01 11:30:00") == 0  # 11:00 is not after 11:15
    assert total("2h", "2024-01-01 12:00:00") == 4  # 10:00 is not strictly after 10:00
    assert total("0h", "2024-01-01 09:30:00") == 5  # later hours have no upper bound


def test_overview_rates(logs):
    row = metrics.overview(hourly_rollup(logs), "24h", "2024-01-01 12:00:00").collect()[0]
    assert (row.total_requests, row.success_rate, row.error_rate) == (6, 0.6667, 0.1667)
    assert row.avg_latency_ms == 253.33 and row.total_cost_usd == 2.5


def test_percentiles_use_arrival_time(logs):
    row = metrics.percentiles(logs, "1h", "2024-01-01 12:00:00").collect()[0]
    assert (row.sample_size, row.dur_p50, row.ttft_p50) == (1, 1000.0, None)
    row = metrics.percentiles(logs, "24h", "2024-01-01 12:00:00").collect()[0]
    assert (row.sample_size, row.dur_p50, row.dur_p95, row.avg_tps) == (3, 300.0, 930.0, 2.5)


def test_request_metrics_count_timeouts_as_failures(logs):
    row = metrics.request_metrics(logs).collect()[0]
    assert (row.total_requests, row.success_count, row.failure_count, row.cancelled_count) == (7, 4, 2, 1)


def test_recent_logs(logs):
    assert [r.event_id for r in reports.recent_logs(logs, 2).collect()] == ["e7", "e5"]
    got = reports.recent_logs(logs, 10, status="error", provider="p", conversation_id="c1")
    assert [r.event_id for r in got.collect()] == ["e3"]
    for bad in (0, 501):
        with pytest.raises(ValueError):
            reports.recent_logs(logs, bad)
    shown = reports.serialise_logs(reports.recent_logs(logs, 500)).collect()
    by_id = {r.event_id: r for r in shown}
    assert by_id["e1"].completed_at == "2024-01-01T10:59:59.999999+00:00"
    assert by_id["e2"].completed_at == "2024-01-01T11:00:00+00:00"
    assert by_id["e6"].completed_at is None and by_id["e1"].estimated_cost_usd == 0.5


def test_blocked_event_shape(spark):
    requests = spark.createDataFrame(
        [("r1", "c", 0, ts("2024-01-01 10:00:00"), "p", "m", "w" * 45_000)],
        "request_id string, conversation_id string, seq long, started_at timestamp, "
        "provider string, model string, content string",
    )
    messages = requests.select("conversation_id", "seq", F.lit("user").alias("role"), "content")
    event = governance.blocked_events(governance.govern(requests, messages)).collect()[0]
    assert event.block_reason == "token_budget_exceeded" and event.status == "error"
    assert "estimated 11250 tokens exceeds the 8000-token limit" in event.error_message
    assert event.completed_at == event.started_at and event.duration_ms == 0
    assert len(event.prompt_preview) == 200 and event.tokens_in is None


def test_25_calls_in_a_minute(spark):
    calls = spark.createDataFrame(
        [(f"r{i:02d}", "c", ts("2024-01-01 10:00:00").replace(second=i)) for i in range(25)],
        "request_id string, conversation_id string, started_at timestamp",
    )
    over = [r.request_id for r in governance.flag_rate_limited(calls).where("over_rate").collect()]
    assert sorted(over) == [f"r{i}" for i in range(20, 25)]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(
        [
            ("c1", 0, "user", "hello there, this is a long opening", "completed", ts("2024-01-01 10:00:00")),
            ("c1", 1, "assistant", "hi", "completed", ts("2024-01-01 10:00:01")),
            ("c2", 0, "system", "be brief", "completed", ts("2024-01-01 09:00:00")),
            ("c2", 1, "user", "ok?", "completed", ts("2024-01-01 09:00:05")),
        ],
        "conversation_id string, seq long, role string, content string, status string, created_at timestamp",
    )


def test_conversations_from_messages(messages):
    got = {r.conversation_id: r for r in conv.conversation_table(messages).collect()}
    assert got["c1"].title == "hello there, this is a long " + "…"
    assert got["c2"].title is None and got["c1"].user_id == "default-user"
    one = conv.one_history(messages, "c1", 1).collect()
    assert [m.content for m in one] == ["hi"]


def test_maintenance(spark, messages):
    table = conv.conversation_table(messages)
    ids = spark.createDataFrame([("c1",), ("c9",), ("c9",)], "conversation_id string")
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert conv.create_missing(table, ids, at).count() == 3
    gone = ids.where("conversation_id = 'c1'")
    assert conv.cascade_delete(messages, gone).count() == 2
    logs = spark.createDataFrame(
        [("e1", "c1"), ("e2", "c2"), ("e3", None)], "event_id string, conversation_id string"
    )
    kept = {r.event_id: r.conversation_id for r in conv.detach_deleted(logs, gone).collect()}
    assert kept == {"e1": None, "e2": "c2", "e3": None}
    updates = spark.createDataFrame(
        [
            ("c1", ts("2024-01-03 00:00:00"), "second", None, False),
            ("c1", ts("2024-01-02 00:00:00"), "first", "cancelled", True),
        ],
        "conversation_id string, changed_at timestamp, title string, status string, touch boolean",
    )
    row = conv.apply_updates(table, updates).where("conversation_id = 'c1'")
    row = row.withColumn("updated_at", F.col("updated_at").cast("string")).collect()[0]
    assert (row.title, row.status, row.updated_at) == ("second", "cancelled", "2024-01-02 00:00:00")


def test_schema_evolution(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1,)], "id int").write.parquet(path)
    spark.createDataFrame([(2, "interrupted")], "id int, status string").write.mode(
        "append"
    ).parquet(path)
    got = conv.read_evolved(spark, path, {"status": "completed", "blocked_count": 0})
    rows = {r.id: (r.status, r.blocked_count) for r in got.collect()}
    assert rows == {1: ("completed", 0), 2: ("interrupted", 0)}


def test_active_streams(spark):
    starts = spark.createDataFrame(
        [("a", ts("2024-01-01 10:00:00")), ("b", ts("2024-01-01 10:30:00")), ("c", ts("2024-01-01 08:00:00"))],
        "request_id string, started_at timestamp",
    )
    ends = spark.createDataFrame(
        [("a", ts("2024-01-01 10:01:00"))], "request_id string, ended_at timestamp"
    )
    live = matching.active_streams(starts, ends, "2024-01-01 10:40:00")
    assert [r.request_id for r in live.collect()] == ["b"]
