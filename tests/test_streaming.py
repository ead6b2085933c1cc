"""Streaming jobs: replay, lateness, restarts, keyed state."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone
from uuid import UUID

import pytest
from pyspark.sql import functions as F

from callscope.operators.percentiles import sketch_quantiles
from callscope.operators.rollup import hourly_rollup
from callscope.plans import metrics
from callscope.session import scratch_dir, short_methods
from callscope.sources import streams
from callscope.sources.files import hadoop_path
from callscope.sources.tables import Warehouse, rebuild_rollup
from callscope.streaming import ingest, serving
from callscope.streaming.cancel import match_cancels_live
from callscope.streaming.ingest import ingest_batch, run_ingest, watermarked_rollup, within_horizon
from callscope.streaming.sinks import fan_out, json_sink, parquet_sink, recent_sink
from callscope.streaming.state import limit_rate, token_bucket, track_streams

T0 = datetime(2024, 1, 1, 10, 30, tzinfo=timezone.utc).timestamp()


def event(n: int, at: float = T0, **changes) -> dict:
    doc = {
        "event_id": str(UUID(int=n)),
        "request_id": str(UUID(int=1000 + n)),
        "provider": "openai",
        "model": "gpt-4o",
        "started_at": at,
        "completed_at": at + 1.5,
        "duration_ms": 1500,
        "tokens_in": 100,
        "tokens_out": 10,
        "prompt_preview": "mail me at a@b.org",
    }
    doc.update(changes)
    return doc


def put(folder, name, docs):
    folder.mkdir(exist_ok=True)
    lines = [d if isinstance(d, str) else json.dumps(d) for d in docs]
    (folder / name).write_text("\n".join(lines) + "\n")


def drain(spark, warehouse, folder, checkpoint, **options):
    stream = streams.read_json_files(spark, str(folder), files_per_batch=1)
    query = run_ingest(stream, warehouse, str(checkpoint), **options)
    query.awaitTermination(300)
    assert query.exception() is None


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ingest_replay_lateness_restart(spark, tmp_path):
    inbox = tmp_path / "in"
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    put(inbox, "a.json", [event(n, T0 + n) for n in range(10)] + ["{broken"])
    put(inbox, "b.json", [event(n, T0 + n) for n in range(5, 12)])
    drain(spark, warehouse, inbox, tmp_path / "ck")
    assert warehouse.logs().count() == 12
    # restart from the checkpoint: a late event and a full replay of the first file
    put(inbox, "c.json", [event(50, T0 - 48 * 3600), event(3, T0 + 3), event(3, T0 + 3)])
    drain(spark, warehouse, inbox, tmp_path / "ck")

    logs = warehouse.logs()
    assert logs.count() == logs.select("event_id").distinct().count() == 13
    assert logs.where("pii_detected").count() == 13
    assert logs.select("prompt_preview").distinct().collect()[0][0] == "mail me at <EMAIL_REDACTED>"
    # an event counts once in the rollup however often it was delivered
    kept = warehouse.rollup()
    assert kept.agg(F.sum("request_count")).collect()[0][0] == 13
    assert rows(kept) == rows(rebuild_rollup(logs))
    assert kept.count() == 2
    totals = warehouse.batches().agg(
        F.sum("input_rows"), F.sum("accepted_rows"), F.sum("rejected_rows"), F.sum("duplicate_rows")
    )
    assert tuple(totals.collect()[0]) == (21, 13, 1, 7)
    assert warehouse.dead_letters().select("payload").collect()[0][0] == "{broken"

    compacted = warehouse.compact_into(str(tmp_path / "wh2"))
    assert rows(compacted.rollup()) == rows(kept)
    assert compacted.logs().count() == 13


def test_repeated_batch_changes_nothing(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    raw = spark.createDataFrame(
        [(json.dumps(event(n % 7)),) for n in range(20)], "payload string"
    )
    ingest_batch(raw, 0, warehouse)
    before = rows(warehouse.rollup())
    ingest_batch(raw, 0, warehouse)
    assert rows(warehouse.rollup()) == before
    ingest_batch(raw, 1, warehouse, sketches=True)
    assert rows(warehouse.rollup()) == before
    assert warehouse.sketches().count() == 0  # batch 1 brought nothing new
    ingest_batch(raw, 0, warehouse, sketches=True)
    read = sketch_quantiles(warehouse.sketches(), {"p50": 0.5}).collect()[0]
    assert (read.n, read.p50) == (7, 1500.0)
    assert warehouse.logs().count() == 7


def test_unknown_conversation_goes_to_dead_letters(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    known, other = str(UUID(int=1)), str(UUID(int=2))
    docs = [event(1, conversation_id=known), event(2, conversation_id=other), event(3)]
    raw = spark.createDataFrame([(json.dumps(d),) for d in docs], "payload string")
    conversations = spark.createDataFrame([(known,)], "conversation_id string")
    ingest_batch(raw, 0, warehouse, conversations=conversations)
    assert warehouse.logs().count() == 2
    assert [r.reject_reason for r in warehouse.dead_letters().collect()] == [
        "conversation_id: unknown"
    ]


def test_serving_tables(spark, tmp_path):
    inbox = tmp_path / "in"
    put(inbox, "a.json", [event(n, T0 + n) for n in range(10)])
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    as_of = "2024-01-01 10:45:00"
    at = F.lit("2024-01-01 10:40:00").cast("timestamp")
    drain(
        spark,
        warehouse,
        inbox,
        tmp_path / "ck",
        created_at=at,
        after_batch=serving.refresh(str(tmp_path / "serve"), ["1h"], as_of),
    )
    shown = spark.read.parquet(f"{tmp_path}/serve/overview/window=1h/refresh=0").collect()[0]
    assert shown.total_requests == 10 and shown.avg_latency_ms == 1500.0
    p = spark.read.parquet(f"{tmp_path}/serve/percentiles/window=1h/refresh=0").collect()[0]
    assert (p.dur_p50, p.sample_size) == (1500.0, 10)


def _replay(spark, path, df):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def _finish(df, path, mode="append"):
    query = (
        df.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/ck")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return df.sparkSession.read.parquet(f"{path}/out")


def test_fan_out_isolates_failures(spark, tmp_path):
    def broken(batch, batch_id):
        raise RuntimeError("down")

    sink = fan_out(
        {
            "broken": broken,
            "files": parquet_sink(f"{tmp_path}/p"),
            "json": json_sink(f"{tmp_path}/j"),
            "recent": recent_sink(f"{tmp_path}/r", 3),
        },
        report_path=f"{tmp_path}/report",
    )
    for batch_id in range(2):
        sink(spark.range(batch_id * 10, batch_id * 10 + 5).withColumnRenamed("id", "event_id"), batch_id)
    assert spark.read.parquet(f"{tmp_path}/p").count() == 10
    assert spark.read.json(f"{tmp_path}/j").count() == 10
    recent = spark.read.parquet(f"{tmp_path}/r/side=1")
    assert sorted(r.event_id for r in recent.collect()) == [10, 11, 12]
    report = spark.read.parquet(f"{tmp_path}/report")
    assert report.where("ok").count() == 6
    assert report.where("not ok").select("error").distinct().collect()[0][0] == "down"


def test_sink_that_recovers_gets_what_it_missed(spark, tmp_path):
    down, seen = {0, 1, 3}, []
    files = parquet_sink(f"{tmp_path}/late")

    def unsteady(batch, batch_id):
        seen.append(batch_id)
        if trigger in down:
            raise RuntimeError("down")
        files(batch, batch_id)

    sinks = {"late": unsteady, "steady": parquet_sink(f"{tmp_path}/steady"), "recent": recent_sink(f"{tmp_path}/r", 3)}
    sink = fan_out(sinks, f"{tmp_path}/report", f"{tmp_path}/backlog")

    def batch(n):
        return spark.range(n * 10, n * 10 + 5).withColumnRenamed("id", "event_id")

    for trigger in range(3):
        sink(batch(trigger), trigger)
    # Batch 1 waits behind batch 0; both come before batch 2.
    assert seen == [0, 0, 0, 1, 2]
    assert not list((tmp_path / "backlog" / "rows").glob("batch=*"))
    trigger = 3
    sink(batch(3), 3)
    assert [p.name for p in (tmp_path / "backlog" / "rows").glob("batch=*")] == ["batch=3"]
    # The batch is repeated after a crash: taken as it comes, and nothing waits any more.
    trigger = 4
    sink(batch(3), 3)
    assert seen[5:] == [3, 3]
    assert not list((tmp_path / "backlog").glob("*/batch=*")) and not list((tmp_path / "backlog").glob("missed/*/batch=*"))
    late, steady = (sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/{n}").collect()) for n in ("late", "steady"))
    assert late == steady == [n * 10 + i for n in range(4) for i in range(5)]
    report = spark.read.parquet(f"{tmp_path}/report").where("sink = 'late' and ok").select("batch_id")
    assert sorted(r.batch_id for r in report.collect()) == [0, 1, 2, 3]


def _at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def test_publish_and_console_documents(spark, tmp_path):
    from callscope.operators.decode import decode_events, split_rejects

    raw = spark.createDataFrame([(json.dumps(event(1)),)], "payload string")
    accepted, _ = split_rejects(decode_events(raw))
    stream = _replay(spark, tmp_path / "e", accepted)
    query = streams.publish_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(120)
    doc = json.loads(spark.read.text(f"{tmp_path}/out").collect()[0][0])
    assert doc["event_id"] == event(1)["event_id"] and doc["metadata"] == {}
    assert doc["conversation_id"] is None


def _triggers(spark, path, parts, schema, job):
    """What a job writes when each (arrival second, rows) comes in a trigger of its own."""
    for n, (arrived, part) in enumerate(parts):
        frame = spark.createDataFrame(part, schema).withColumn("arrived_at", F.lit(_at(arrived)))
        frame.coalesce(1).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(frame.schema).parquet(f"{path}/in")
        out = _finish(job(source), path)
    return out


_CHANGE = "request_id string, kind string, at timestamp"


@pytest.mark.parametrize("size", ["10000", "1"])
def test_track_streams(spark, tmp_path, size):
    """Earliest start and end count, an early end is kept, and silence expires; batch cuts don't matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        parts = [
            (0, [("a", "start", _at(500)), ("a", "start", _at(0)), ("a", "end", _at(5000)), ("a", "end", _at(600)), ("early", "end", _at(60))]),
            (100, [("early", "start", _at(50)), ("a", "start", _at(0)), ("a", "end", _at(600)), ("slow", "start", _at(100)), ("open", "start", _at(90_000))]),
            (4000, [("slow", "end", _at(3800))]),
            (20_000, [("z", "start", _at(20_000))]),
        ]
        out = _triggers(spark, tmp_path, parts, _CHANGE, track_streams)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ms = lambda s: int(_at(s).timestamp() * 1000)
    got = sorted((r.request_id, r.change, r.at_ms) for r in out.collect())
    start = got[1][2]  # the zone of the test machine doesn't matter
    assert [(r, c, at - start) for r, c, at in got] == sorted([
        ("a", "registered", 0), ("a", "ended", 600_000), ("early", "registered", 50_000), ("early", "ended", 60_000), ("slow", "registered", 100_000),
        ("slow", "expired", 3_700_000), ("open", "registered", 90_000_000), ("z", "registered", 20_000_000),
    ]) and ms(0)


_REQUEST = "request_id string, conversation_id string, started_at timestamp"


@pytest.mark.parametrize("size", ["10000", "7"])
def test_live_rate_limit(spark, tmp_path, size):
    """Within a trigger the earliest requests are admitted, and a late one gets its decision too."""
    from callscope.operators.governance import flag_rate_limited

    requests = [(f"r{i:03d}", "c1" if i % 3 else "c2", _at(i * 4)) for i in range(60)]
    df = spark.createDataFrame(requests, _REQUEST)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        parts = [(0, requests[::-1]), (50_000, [("late", "c1", _at(1)), ("new", "c3", _at(50_000))]), (60_000, [("later", "c1", _at(2))])]
        out = _triggers(spark, tmp_path, parts, _REQUEST, lambda s: limit_rate(s, limit=3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.request_id: r.over_rate for r in out.collect()}
    assert len(got) == 63 and {"late", "later"} <= got.keys()
    assert {k: v for k, v in got.items() if k[0] == "r"} == {r.request_id: r.over_rate for r in flag_rate_limited(df, limit=3).collect()}


@pytest.mark.parametrize("size", ["10000", "2"])
def test_token_bucket(spark, tmp_path, size):
    """Decided by time across triggers, in whatever order requests arrive."""
    times = [0, 1, 2, 3, 63, 64]
    rows = [(f"r{i}", "c", _at(t)) for i, t in enumerate(times)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        parts = [(0, rows[3:][::-1]), (10, rows[:3]), (5000, [("x", "d", _at(5000))]), (6000, [("late", "c", _at(2)), ("y", "d", _at(9000))])]
        out = _triggers(spark, tmp_path, parts, _REQUEST, lambda s: token_bucket(s, 2, 1.0))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.request_id: r.over_rate for r in out.collect()}
    assert [got[f"r{i}"] for i in range(6)] == [False, False, True, True, False, True]
    assert "late" in got and got["x"] is False


def test_cancels_meet_live_streams(spark, tmp_path):
    """The first cancel in time takes effect, however long the stream has been open."""
    schema = "request_id string, cancel_ts timestamp, started_at timestamp, ended_at timestamp"
    parts = [
        (0, [("a", _at(7), None, None), ("b", _at(500), None, None), ("c", _at(1), None, None), ("long", _at(9000), None, None)]),
        (20, [("a", None, _at(0), _at(10)), ("b", None, _at(0), _at(10)), ("a", _at(5), None, None), ("a", _at(5), None, None), ("long", None, _at(0), _at(10_000))]),
        (30_000, [("z", _at(30_000), None, None)]),
    ]
    split = lambda s: match_cancels_live(s.where("cancel_ts is not null"), s.where("cancel_ts is null"))
    out = _triggers(spark, tmp_path, parts, schema, split)
    assert sorted((r.request_id, r.cancel_ts) for r in out.collect()) == [("a", _at(5)), ("long", _at(9000))]


def test_watermarked_variants(spark, tmp_path):
    data = [
        (str(i % 5), _at(i * 600), "p", "m", 10, "success", False) for i in range(40)
    ]
    df = spark.createDataFrame(
        data,
        "event_id string, completed_at timestamp, provider string, model string, "
        "duration_ms int, status string, blocked boolean",
    )
    source = _replay(spark, tmp_path / "in", df)
    (tmp_path / "x").mkdir()
    out = _finish(watermarked_rollup(source, "0 seconds"), tmp_path / "x")
    expected = hourly_rollup(
        df.withColumn("tokens_in", F.lit(0))
        .withColumn("tokens_out", F.lit(0))
        .withColumn("estimated_cost_usd", F.lit(None).cast("decimal(20,8)"))
    )
    closed = expected.where(F.col("hour_bucket") < F.lit(_at(6 * 3600)))
    assert rows(out.select("hour_bucket", "request_count")) == rows(
        closed.select("hour_bucket", "request_count")
    )
    (tmp_path / "y").mkdir()
    once = _finish(within_horizon(source, "completed_at", "30 days"), tmp_path / "y")
    assert once.count() == 5


def test_overview_of_an_empty_window(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "none"))
    row = metrics.overview(warehouse.rollup(), "1h", "2024-01-01 10:30:00").collect()[0]
    assert row.total_requests == 0 and row.success_rate == 0.0 and row.avg_latency_ms == 0.0
    p = metrics.percentiles(warehouse.logs(), "1h", "2024-01-01 10:30:00").collect()[0]
    assert p.dur_p50 is None and p.sample_size == 0


def test_state_is_kept_by_slot(spark, tmp_path):
    """The store holds a table and a timer for each slot, however many keys there are, and a null key is one of them."""
    rows = [(f"r{n}", "start", _at(n)) for n in range(500)] + [(f"r{n}", "end", _at(n + 9)) for n in range(0, 500, 2)] + [(None, "start", _at(3))]
    frame = spark.createDataFrame(rows, _CHANGE).withColumn("arrived_at", F.lit(_at(0)))
    frame.write.parquet(f"{tmp_path}/in")
    changes = track_streams(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), slots=4)
    job = changes.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress) <= 3 * 4
    got = {(r.request_id, r.change) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(f"r{n}", "registered") for n in range(500)} | {(f"r{n}", "ended") for n in range(0, 500, 2)} | {(None, "registered")}


def test_batch_keeps_decoded_rows_aside_without_good_payloads(spark, tmp_path, monkeypatch):
    aside, seen = [], {}

    def named(spark, label):
        aside.append(scratch_dir(spark, label))
        return aside[-1]

    def look(rows):
        decoded = spark.read.parquet(aside[-1])
        seen["payloads"] = {r["reject_reason"] is None: r["payload"] for r in decoded.collect()}
        seen["limit"] = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
        return rows

    monkeypatch.setattr(ingest, "scratch_dir", named, raising=False)
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    sent = spark.createDataFrame([(json.dumps(event(1)),), ("broken",)], "payload string")
    warehouse = Warehouse(spark, str(tmp_path / "tables"))
    ingest_batch(sent, 0, warehouse, [look, *ingest.standard_stages(spark)], created_at=F.lit("2024-01-01").cast("timestamp"))
    assert seen == {"payloads": {True: None, False: "broken"}, "limit": "8000"}
    assert [r["payload"] for r in warehouse.dead_letters().collect()] == ["broken"]
    assert warehouse.logs().count() == 1
    left = [p for p in aside if _exists(spark, p)]
    assert not left and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit


def _exists(spark, path):
    found, system = hadoop_path(spark, path)
    return system.exists(found)


def test_short_methods_end_with_an_error(spark):
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    with pytest.raises(ValueError), short_methods(spark):
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
        raise ValueError
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
