"""Bucketed tables with manifests, the index of event ids, and stored conversations."""

from __future__ import annotations

import json
from threading import Barrier
from uuid import UUID

import pytest
from pyspark.sql import functions as F

from callscope.schemas import struct_of
from callscope.sources import bucketed
from callscope.sources.bucketed import BucketedTable, LostRace
from callscope.sources.dimensions import ConversationStore
from callscope.sources.id_index import IdIndex
from callscope.sources.tables import Warehouse
from callscope.streaming.ingest import ingest_batch

SCHEMA = struct_of("name string, n long")
T0 = 1704067200.0


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def held(table, **how):
    return sorted((tuple(r) for r in table.read(**how).collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable(spark, str(tmp_path / "table"), SCHEMA, "name", 4)


def test_never_written_table_is_empty(table):
    assert held(table) == [] and table.versions() == [] and table.manifest().version == 0


def test_append_fold_and_delete(spark, table, monkeypatch):
    monkeypatch.setattr(bucketed, "FRESH", 3)
    rows = [(f"k{n}", n) for n in range(12)] + [(None, 0)]
    for n, row in enumerate(rows):
        table.append(frame(spark, row), ("load", n))
    assert held(table) == sorted(rows, key=str)
    assert len(table.manifest().fresh) <= 3 and table.manifest().buckets
    table.append(frame(spark, ("again", 1)), ("load", 5))  # a batch that has been applied
    assert held(table) == sorted(rows, key=str)
    table.delete(frame(spark, ("k3", 0), ("k7", 0), ("none", 0), (None, 0)))
    assert held(table) == sorted((r for r in rows if r[0] not in ("k3", "k7")), key=str)


def test_only_touched_buckets_are_rewritten(spark, table):
    table.rewrite(range(4), lambda old: frame(spark, *[(f"k{n}", n) for n in range(40)]))
    before = table.manifest()
    (touched,) = table.touched(frame(spark, ("k5", 0)))
    table.rewrite([touched], lambda old: old.withColumn("n", F.col("n") + 100))
    after = table.manifest()
    assert [b for b in range(4) if before.buckets[b] != after.buckets[b]] == [touched]
    assert {n >= 100 for name, n in held(table) if table.touched(frame(spark, (name, 0))) == [touched]} == {True}
    assert sorted(n % 100 for _, n in held(table)) == list(range(40))
    with pytest.raises(ValueError, match="not rewritten"):
        table.rewrite([touched], lambda old: frame(spark, *[(f"k{n}", n) for n in range(40)]))
    assert table.manifest() == after


def test_reading_a_bucket_lists_its_files_only(spark, table):
    table.rewrite(range(4), lambda old: frame(spark, *[(f"k{n}", n) for n in range(40)]))
    (touched,) = table.touched(frame(spark, ("k5", 0)))
    files = table.read([touched]).inputFiles()
    assert files and all(f"_bucket={touched}/" in f for f in files)
    assert len(files) < len(table.read().inputFiles())


def test_a_writer_that_dies_before_the_swap_changes_nothing(spark, table, monkeypatch):
    table.append(frame(spark, ("a", 1), ("b", 2)))
    reader = table.read()
    with monkeypatch.context() as dying:
        dying.setattr(BucketedTable, "_put", lambda self, manifest: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError, match="died"):
            table.delete(frame(spark, ("a", 0)), ("run", 0))
    assert held(table) == [("a", 1), ("b", 2)]
    table.delete(frame(spark, ("a", 0)), ("run", 0))
    table.delete(frame(spark, ("a", 0)), ("run", 0))
    assert held(table) == [("b", 2)]
    assert sorted(r["name"] for r in reader.collect()) == ["a", "b"]  # readers keep their version


def test_two_writers_of_one_version(spark, table):
    table.append(frame(spark, ("a", 1)))
    stale = table.manifest()
    table.append(frame(spark, ("b", 2)))
    with pytest.raises(LostRace):
        table._put(table._next(stale, None))
    assert held(table) == [("a", 1), ("b", 2)]


def test_vacuum_keeps_what_is_named(spark, table):
    for n in range(4):
        table.append(frame(spark, (f"k{n}", n)))
        table.delete(frame(spark, (f"k{n - 1}", 0)))
    old = table.manifest(table.versions()[-2])
    table.vacuum(2)
    assert len(table.versions()) == 2 and held(table) == [("k3", 3)]
    assert held(table, manifest=old) == [("k2", 2), ("k3", 3)]


def ids(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "event_id string")


def test_index_leaves_out_the_batch_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucketed, "FRESH", 2)
    index = IdIndex(spark, str(tmp_path / "ids"), 8)
    seen = lambda batch, *names: sorted(r[0] for r in index.among(ids(spark, *names), batch).collect())
    index.build(ids(spark, "old", "old", "older"))
    for n in range(5):
        index.add(ids(spark, f"a{n}", f"b{n}"), f"run-{n}")
    assert seen("run-5", "a0", "a4", "old", "new", None) == ["a0", "a4", "old"]
    assert seen("run-4", "a3", "a4", "b4") == ["a3"]
    index.add(ids(spark, "c4"), "run-4")  # the batch again, with other ids
    assert seen("run-5", "a4", "c4", "a3") == ["a3", "c4"]
    (bucket,) = index.table.touched(ids(spark, "old"))
    files = index.candidates(ids(spark, "old")).inputFiles()
    assert all(f"_bucket={bucket}/" in f for f in files if "_bucket=" in f)


def event(n, **more):
    return {
        "event_id": str(UUID(int=n)), "request_id": str(UUID(int=1000 + n)), "provider": "openai", "model": "gpt-4o", "started_at": T0 + n,
        "completed_at": T0 + n + 1, "duration_ms": 1000, "status": "success", **more,
    }


def payloads(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "payload string")


def test_ingest_reads_the_index_and_not_the_log(spark, tmp_path):
    """Old ids are found however old they are; a log without an index gets one."""
    tables = Warehouse(spark, str(tmp_path / "wh"))
    old, new = F.lit("2020-01-01").cast("timestamp"), F.lit("2024-06-01").cast("timestamp")
    ingest_batch(payloads(spark, event(1), event(2)), 0, tables, created_at=old)
    ingest_batch(payloads(spark, event(2), event(3)), 1, tables, created_at=new)
    assert tables.logs().count() == 3
    plan = tables.event_ids().among(ids(spark, str(UUID(int=2))), "x")._jdf.queryExecution().toString()
    assert "inference_logs" not in plan
    moved = Warehouse(spark, str(tmp_path / "wh"), run="later")
    moved.event_ids = lambda: IdIndex(spark, str(tmp_path / "other"))
    ingest_batch(payloads(spark, event(1), event(4), event(4)), 0, moved, created_at=new)
    assert sorted(r.event_id for r in tables.logs().collect()) == [str(UUID(int=n)) for n in (1, 2, 3, 4)]


def test_batch_that_dies_between_log_and_index_is_repeated(spark, tmp_path, monkeypatch):
    tables = Warehouse(spark, str(tmp_path / "wh"))
    ingest_batch(payloads(spark, event(1)), 0, tables)
    raw = payloads(spark, event(1), event(2), event(3))
    for name in ("add_to_rollup", "append_logs"):
        with monkeypatch.context() as dying:
            dying.setattr(Warehouse, name, lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
            with pytest.raises(RuntimeError, match="died"):
                ingest_batch(raw, 1, tables)
    ingest_batch(raw, 1, tables)
    ingest_batch(payloads(spark, event(3), event(4)), 2, tables)
    assert sorted(r.event_id for r in tables.logs().collect()) == [str(UUID(int=n)) for n in (1, 2, 3, 4)]
    assert tables.rollup().agg(F.sum("request_count")).first()[0] == 4


def test_cascade_survives_a_crash_between_tables(spark, tmp_path, monkeypatch):
    names = [str(UUID(int=n)) for n in range(6)]
    tables = Warehouse(spark, str(tmp_path / "wh"))
    store = ConversationStore(spark, str(tmp_path / "conversations"), 4)
    at = F.lit("2024-01-01").cast("timestamp")
    store.create(spark.createDataFrame([(x,) for x in names], "conversation_id string"), at)
    said = [(x, seq, "user", "hello") for x in names for seq in range(3)]
    store.append(spark.createDataFrame(said, "conversation_id string, seq long, role string, content string"))
    for n, day in ((0, "2024-01-01"), (1, "2024-01-02")):
        came = F.lit(day).cast("timestamp")
        ingest_batch(payloads(spark, *[event(10 * n + k, conversation_id=names[k + n]) for k in range(3)]), n, tables, created_at=came)
    gone = spark.createDataFrame([(names[0],), (names[0],), (None,), ("other",)], "conversation_id string")
    with monkeypatch.context() as dying:
        dying.setattr(store.conversation_table, "delete", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError, match="died"):
            store.delete(gone, tables, ("delete", 0))
    assert store.conversations().count() == 6 and store.messages().count() == 15
    store.delete(gone, tables, ("delete", 0))
    assert sorted(r.conversation_id for r in store.conversations().collect()) == names[1:]
    assert store.messages(gone).count() == 0
    log = tables.logs().collect()
    assert len(log) == 6 and sorted(r.conversation_id or "" for r in log) == ["", names[1], names[1], names[2], names[2], names[3]]
    assert tables.rollup().agg(F.sum("request_count")).first()[0] == 6


def test_dates_are_compacted_side_by_side(spark, tmp_path, monkeypatch):
    warehouse = Warehouse(spark, str(tmp_path / "tables"))
    for day in ("01", "02", "03"):
        (tmp_path / f"tables/inference_logs/ingest_date=2024-01-{day}/batch=main-0").mkdir(parents=True)
    met, taken = Barrier(2, timeout=20), []

    def compact(table, day):
        met.wait()  # breaks unless two dates are there at once
        taken.append(day)

    monkeypatch.setattr(warehouse, "compact_date", compact)
    warehouse.compact_closed("2024-01-03", ["inference_logs"])
    assert sorted(taken) == ["2024-01-01", "2024-01-02"]


def test_empty_index_does_not_read_the_ids(spark, tmp_path, monkeypatch):
    index = IdIndex(spark, str(tmp_path / "ids"))
    monkeypatch.setattr(index.table, "touched", lambda ids: pytest.fail("ids were read"))
    assert index.among(spark.createDataFrame([("a",)], "event_id string")).count() == 0
