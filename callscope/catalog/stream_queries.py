"""Registered streaming jobs: each streams a whole table through and returns what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.catalog import queries as q
from callscope.catalog import views as v
from callscope.catalog.queries import _stream_spans, query
from callscope.functions import timing
from callscope.operators import governance
from callscope.session import STATE_STORE, scratch_dir, short_methods
from callscope.sources.dimensions import ConversationStore
from callscope.sources.streams import read_json_files
from callscope.sources.tables import Warehouse
from callscope.streaming.cancel import match_cancels_live
from callscope.streaming.ingest import ingest_batch, run_ingest, standard_stages, within_horizon
from callscope.streaming import serving
from callscope.streaming.sinks import fan_out, json_sink, parquet_sink, recent_sink
from callscope.streaming.state import limit_rate, token_bucket, track_streams

# Arrival times of the triggers; the last one is past every timer.
_ARRIVALS = ("2023-12-30 00:00:00", "2023-12-30 00:00:10", "2030-01-01 00:00:00")
# The same, two months after the events.
_REPLAYED = ("2024-03-30 00:00:00", "2024-03-30 00:00:10", "2030-01-01 00:00:00")
# The stored events span a month, in no particular order.
_ANY_ORDER = "60 days"


def _job(spark: SparkSession, df: DataFrame, folder: str) -> None:
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, STATE_STORE)
    try:
        df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def _in_triggers(spark: SparkSession, parts: Sequence[DataFrame], label: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a job writes when each part arrives after the one before has been processed."""
    folder = scratch_dir(spark, label)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        schema = spark.read.parquet(f"{folder}/in").schema
        out = job(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        _job(spark, out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _dealt(rows: DataFrame, trigger: Column, repeated: Column, arrivals: Sequence[str] = _ARRIVALS) -> list[DataFrame]:
    """Rows by trigger number (0 or 1) with their arrival; repeated ones come in both."""
    dealt = rows.withColumn("_trigger", trigger).withColumn("_again", repeated)
    parts = []
    for n, at in enumerate(arrivals[:2]):
        own = (F.col("_trigger") == n) | (F.col("_again"))
        parts.append(dealt.where(own).drop("_trigger", "_again").withColumn("arrived_at", F.lit(at).cast("timestamp")))
    return parts


def _last(row: DataFrame) -> DataFrame:
    return row.withColumn("arrived_at", F.lit(_ARRIVALS[2]).cast("timestamp"))


@query
def streamed_ingest(spark, sf):
    """The ingest job over all payloads in three triggers, with repeats inside and across them."""
    folder = scratch_dir(spark, "ingest")
    sent = v.payloads(spark, sf)
    even, again = F.col("offset") % 2 == 0, F.col("offset") % 50
    warehouse = Warehouse(spark, f"{folder}/tables")
    for df in (sent.where(even), sent.where(~even | (again == 0)), sent.where(again < 2).union(sent.where(again == 1))):
        with short_methods(spark):
            df.select("payload").write.mode("append").text(f"{folder}/in")
        run_ingest(read_json_files(spark, f"{folder}/in"), warehouse, f"{folder}/checkpoint").awaitTermination()
    return warehouse.rollup()


def _stored_conversations(spark, sf, label: str) -> ConversationStore:
    """Conversations and messages of the tables, stored; the messages in two batches."""
    store = ConversationStore(spark, scratch_dir(spark, label), 16)
    name = F.col("conversation_id").cast("string").alias("conversation_id")
    heads, told = v.conversation_rows(spark, sf), v.messages(spark, sf)
    store.put(heads.select(name, *heads.columns[1:]), ("load", 0))
    for n in range(2):
        store.append(told.where(F.col("seq") % 2 == n).select(name, *told.columns[1:]), ("load", n))
    return store


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("conversation_id", F.col("conversation_id").cast("long"))


@query
def stored_updates(spark, sf):
    """The changes of `conversation_updates` merged into the stored table, in two batches and one of them twice."""
    store = _stored_conversations(spark, sf, "stored-updates")
    updates = q.updates_from_calls(spark, sf).withColumn("conversation_id", F.col("conversation_id").cast("string"))
    early = F.col("changed_at") < F.lit("2024-01-16").cast("timestamp")
    for n, part in ((0, early), (1, ~early), (1, ~early)):
        store.update(updates.where(part).drop("event_id"), ("updates", n))
    return _numbered(store.conversations())


@query
def stored_creates(spark, sf):
    """Conversations that a batch of calls created in the stored table."""
    store = _stored_conversations(spark, sf, "stored-creates")
    ids = v.inference_events(spark, sf).select(F.col("conversation_id").cast("string").alias("conversation_id"))
    store.create(ids, F.lit(v.AS_OF).cast("timestamp"))
    return _numbered(store.conversations())


@query
def stored_cascade(spark, sf):
    """Stored messages after a quarter of the conversations is deleted, and how many conversations are left with them."""
    store = _stored_conversations(spark, sf, "stored-cascade")
    gone = v.conversation_rows(spark, sf).where("conversation_id % 4 = 1").select(F.col("conversation_id").cast("string").alias("conversation_id"))
    store.delete(gone, batch=("delete", 0))
    left = store.conversations().select("conversation_id")
    return _numbered(store.messages().join(left, "conversation_id", "left_semi").select("conversation_id", "seq", "role", "status"))


@query
def stored_detach(spark, sf):
    """The stored log after a third of its conversations is deleted: rows by whether they have a conversation."""
    folder = scratch_dir(spark, "stored-detach")
    warehouse = Warehouse(spark, f"{folder}/tables")
    store = ConversationStore(spark, f"{folder}/conversations", 16)
    came = timing.epoch_to_timestamp(F.col("started_at"))
    sent = v.payloads(spark, sf)
    for n in range(2):
        ingest_batch(sent.where(F.col("offset") % 2 == n).select("payload"), n, warehouse, created_at=came)
    named = warehouse.logs().select("conversation_id").where("conversation_id is not null").distinct()
    gone = named.where(F.substring("conversation_id", -1, 1) < "5")
    gone.write.parquet(f"{folder}/gone")
    store.delete(spark.read.parquet(f"{folder}/gone"), warehouse, ("delete", 0))
    return warehouse.logs().groupBy("provider", "status").agg(F.count(F.lit(1)).alias("n"), F.count("conversation_id").alias("attached"))


@query
def stored_window(spark, sf):
    """A day's window of the stored log and of its compacted copy, ingested in two batches."""
    folder = scratch_dir(spark, "stored")
    warehouse = Warehouse(spark, f"{folder}/tables")
    sent = v.payloads(spark, sf)
    came = timing.epoch_to_timestamp(F.col("started_at"))
    for n, part in enumerate((sent.where("offset % 3 < 2"), sent.where("offset % 3 > 0"))):
        ingest_batch(part.select("payload"), n, warehouse, created_at=came)
    small = warehouse.compact_into(f"{folder}/compacted")
    read = lambda tables, name: tables.logs("24h", v.AS_OF).groupBy("provider", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("duration_ms")
    ).withColumn("copy", F.lit(name))
    return read(warehouse, "stored").unionByName(read(small, "compacted"))


@query
def served_tables(spark, sf):
    """The dashboard's table by provider, as a refresh after an ingest batch leaves it."""
    folder = scratch_dir(spark, "served")
    warehouse = Warehouse(spark, f"{folder}/tables")
    came = timing.epoch_to_timestamp(F.col("started_at"))
    ingest_batch(v.payloads(spark, sf).select("payload"), 0, warehouse, created_at=came)
    serving.refresh(f"{folder}/serve", ["24h", "30d"], v.AS_OF)(warehouse, 0)
    complete = spark.read.parquet(f"{folder}/serve/_complete").select("refresh")
    table = spark.read.parquet(f"{folder}/serve/by_provider/window=30d")
    return table.join(complete, "refresh", "left_semi").select("provider", "model", "requests")


@query
def served_percentiles(spark, sf):
    """The percentiles of three windows as a refresh leaves them, from the histograms that two batches stored."""
    folder = scratch_dir(spark, "served-percentiles")
    warehouse = Warehouse(spark, f"{folder}/tables")
    came, sent = timing.epoch_to_timestamp(F.col("started_at")), v.payloads(spark, sf)
    # Payloads carry no output rate; their durations are kept as they came.
    rate = lambda rows: rows.withColumn("tokens_per_second", timing.tokens_per_second(F.col("tokens_out"), F.col("duration_ms")))
    stages = [*standard_stages(spark), rate]
    for n in range(2):
        ingest_batch(sent.where(F.col("offset") % 2 == n).select("payload"), n, warehouse, stages, created_at=came)
    serving.refresh(f"{folder}/serve", ["100m", "24h", "30d"], v.AS_OF)(warehouse, 1)
    return spark.read.parquet(f"{folder}/serve/percentiles").drop("refresh")


@query
def compacted_dates(spark, sf):
    """The stored log by day after three batches: the first two compacted before the third, which comes to the same dates."""
    warehouse = Warehouse(spark, scratch_dir(spark, "compacted-dates"))
    came, sent = timing.epoch_to_timestamp(F.col("started_at")), v.payloads(spark, sf)
    for n in range(4):  # the last one repeats the third's payloads and lets it be settled
        ingest_batch(sent.where(F.col("offset") % 3 == min(n, 2)).select("payload"), n, warehouse, created_at=came)
        if n == 2:
            warehouse.compact_closed("2024-01-20", ["inference_logs"])
    warehouse.drop_covered("inference_logs")
    by_day = warehouse.logs().groupBy("provider", "status", F.to_date("started_at").alias("day"))
    return by_day.agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("duration_ms"))


@query
def fanned_out(spark, sf):
    """Rows that each sink holds after two batches, one sink failing in both."""
    folder = scratch_dir(spark, "fan-out")

    def broken(batch: DataFrame, batch_id: int) -> None:
        raise RuntimeError("down")

    sinks = {"broken": broken, "files": parquet_sink(f"{folder}/files"), "json": json_sink(f"{folder}/json"), "recent": recent_sink(f"{folder}/recent")}
    write = fan_out(sinks, f"{folder}/report")
    calls = v.inference_events(spark, sf).select("event_id", "status")
    for n in range(2):
        for _ in range(n + 1):  # a repeated batch changes nothing
            write(calls.where(F.col("event_id") % 2 == n), n)
    held = [spark.read.parquet(f"{folder}/files"), spark.read.json(f"{folder}/json"), spark.read.parquet(f"{folder}/recent/side=1")]
    failures = spark.read.parquet(f"{folder}/report").where("not ok and sink = 'broken'")
    out = [df.agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("n")) for name, df in zip(("files", "json", "recent", "failures"), [*held, failures], strict=True)]
    return reduce(DataFrame.union, out)


@query
def fanned_out_recovered(spark, sf):
    """Rows by status that two sinks hold after three batches, one of them down until the last."""
    folder = scratch_dir(spark, "fan-out-recovered")
    late = parquet_sink(f"{folder}/late")

    def down_at_first(batch: DataFrame, batch_id: int) -> None:
        if newest < 2:
            raise RuntimeError("down")
        late(batch, batch_id)

    write = fan_out({"late": down_at_first, "steady": parquet_sink(f"{folder}/steady")}, backlog=f"{folder}/backlog")
    calls = v.inference_events(spark, sf).select("event_id", "status")
    for newest in range(3):
        write(calls.where(F.pmod("event_id", F.lit(3)) == newest), newest)
    held = [spark.read.parquet(f"{folder}/{sink}").select(F.lit(sink).alias("sink"), "status") for sink in ("late", "steady")]
    return reduce(DataFrame.union, held).groupBy("sink", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def streamed_dedup(spark, sf):
    """A replayed stream with repeats dropped in state, in two triggers."""
    calls = v.inference_events(spark, sf).select("event_id", "status", "started_at")
    parts = _dealt(calls, F.col("event_id") % 2, F.col("event_id") % 5 == 0)
    once = _in_triggers(spark, parts, "dedup", lambda s: within_horizon(s.drop("arrived_at"), "started_at", _ANY_ORDER))
    return once.select("event_id", "status")


def _tracked(spark, sf, arrivals):
    starts, ends = _stream_spans(spark, sf)
    name = F.col("request_id").cast("string").alias("request_id")
    begun = starts.select(name, F.lit("start").alias("kind"), F.col("started_at").alias("at"), F.col("request_id").alias("_n"))
    # Ends a day later are never sent: those streams expire.
    done = ends.where(F.col("request_id") % 3 != 0).select(name, F.lit("end").alias("kind"), F.col("ended_at").alias("at"), F.col("request_id").alias("_n"))
    ahead = (F.col("_n") % 5 == 1) == (F.col("kind") == "end")
    trigger = F.when(ahead | (F.col("_n") % 7 == 0), 0).otherwise(1)
    parts = [p.drop("_n") for p in _dealt(begun.unionByName(done), trigger, F.col("_n") % 4 == 0, arrivals)]
    flush = begun.limit(0).drop("_n").unionByName(spark.range(1).select(F.lit("flush").alias("request_id"), F.lit("start").alias("kind"), F.lit("2030-01-01").cast("timestamp").alias("at")))
    changes = _in_triggers(spark, [*parts, _last(flush)], "registry", track_streams)
    return changes.where("request_id <> 'flush'").select("request_id", "change")


@query
def tracked_streams(spark, sf):
    """Registry changes of every stream: repeats, ends before their starts, and streams that never end."""
    return _tracked(spark, sf, _ARRIVALS)


@query
def replayed_streams(spark, sf):
    """The same changes from a replay two months later."""
    return _tracked(spark, sf, _REPLAYED)


def _requests(spark, sf) -> DataFrame:
    return v.inference_events(spark, sf).select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("user_id").cast("string").alias("conversation_id"),
        "started_at",
        (F.col("event_id") % 2).alias("_n"),
    )


@query
def streamed_rate_limit(spark, sf):
    """Admitted and refused calls per user and day, two being the limit; most arrive out of order."""
    parts = [p.drop("_n") for p in _dealt(_requests(spark, sf), F.col("_n"), F.lit(False))]
    decided = _in_triggers(spark, parts, "rate", lambda s: limit_rate(s, 2, 86_400))
    return decided.groupBy("conversation_id", "rate_bucket", "over_rate").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def replayed_rate_limit(spark, sf):
    """Every call's decision in a replay two months later: first come, first admitted, by time within a trigger."""
    parts = [p.drop("_n") for p in _dealt(_requests(spark, sf), F.col("_n"), F.lit(False), _REPLAYED)]
    return _in_triggers(spark, parts, "rate", lambda s: limit_rate(s, 2, 86_400)).select("request_id", "over_rate")


@query
def streamed_token_bucket(spark, sf):
    """Every call's decision by a bucket of two tokens that refills once in four hours."""
    parts = [p.drop("_n") for p in _dealt(_requests(spark, sf), F.col("_n"), F.lit(False))]
    flush = spark.range(1).select(F.lit("flush").alias("request_id"), F.lit("flush").alias("conversation_id"), F.lit("2031-01-01").cast("timestamp").alias("started_at"))
    decided = _in_triggers(spark, [*parts, _last(flush)], "bucket", lambda s: token_bucket(s, 2, 1 / 256))
    return decided.select("request_id", "conversation_id", "over_rate")


@query
def bucketed_calls(spark, sf):
    """The same decisions from the whole table at once."""
    return governance.flag_token_bucket(_requests(spark, sf).drop("_n"), 2, 1 / 256).select("request_id", "conversation_id", "over_rate")


def _cancelled(spark, sf, arrivals):
    starts, ends = _stream_spans(spark, sf)
    asked = v.inference_events(spark, sf).select(
        F.col("event_id").cast("string").alias("request_id"),
        v.plus_seconds(F.col("started_at"), F.col("event_id") % 7).alias("cancel_ts"),
        (F.col("event_id") % 3).alias("_n"),
    )
    later = asked.where("_n = 0").withColumn("cancel_ts", v.plus_seconds(F.col("cancel_ts"), F.lit(7200)))
    spans = starts.join(ends, "request_id").select(F.col("request_id").cast("string").alias("request_id"), "started_at", "ended_at", (F.col("request_id") % 3).alias("_n"))
    rows = later.unionByName(asked).unionByName(spans, allowMissingColumns=True)
    parts = _dealt(rows, F.when(F.col("cancel_ts").isNull(), (F.col("_n") + 1) % 2).otherwise(F.col("_n") % 2), F.col("_n") == 2, arrivals)
    flush = spark.range(1).select(F.lit("flush").alias("request_id"), F.lit("2030-01-01").cast("timestamp").alias("cancel_ts"))
    empty = rows.drop("_n").limit(0)
    split = lambda s: match_cancels_live(s.where("cancel_ts is not null"), s.where("cancel_ts is null"))
    found = _in_triggers(spark, [*(p.drop("_n") for p in parts), _last(empty.unionByName(flush, allowMissingColumns=True))], "cancels", split)
    return found.select("request_id", "cancel_ts")


@query
def streamed_cancels(spark, sf):
    """The first cancel in time of each stream: repeats, later ones, and streams open for a day."""
    return _cancelled(spark, sf, _ARRIVALS)


@query
def replayed_cancels(spark, sf):
    """The same cancels from a replay two months later."""
    return _cancelled(spark, sf, _REPLAYED)
