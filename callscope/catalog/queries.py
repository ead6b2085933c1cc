"""Registered queries: each runs one operator, or a few, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.catalog import views as v
from callscope.functions import pii, text, timing
from callscope.operators import chunks as ch
from callscope.operators import conversations as conv
from callscope.operators import decode, enrich, governance, matching, percentiles, rollup
from callscope.plans import logs as log_reports
from callscope.plans import metrics
from callscope.session import scratch_dir, use_utc
from callscope.sources.lookups import load_prices, load_registry, unpriced_models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _finish(df: DataFrame) -> DataFrame:
    """Zone-less UTC timestamps, as the SQL twins produce them."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if f.dataType.typeName() == "timestamp"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _finish(fn(use_utc(spark), sf_dir.rstrip("/")))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


# Reference data and scans


@query
def registry_usage(spark, sf):
    """Registry rows with the calls each model received."""
    calls = v.inference_events(spark, sf).groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("calls")
    )
    return (
        load_registry(spark)
        .join(calls, ["provider", "model"], "left")
        .select(
            "provider",
            "model",
            "context_window",
            "max_tokens_default",
            "supports_streaming",
            F.coalesce("calls", F.lit(0)).alias("calls"),
        )
    )


@query
def unpriced_usage(spark, sf):
    """Calls and tokens of models without a price."""
    missing = unpriced_models(load_registry(spark), load_prices(spark))
    return (
        v.inference_events(spark, sf)
        .join(missing, ["provider", "model"], "left_semi")
        .groupBy("provider", "model")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"))
    )


@query
def table_scan_counts(spark, sf):
    """Rows and time span of the calls and of the messages."""
    calls = v.inference_events(spark, sf).select(
        F.lit("inference_logs").alias("source"), F.col("started_at").alias("t")
    )
    turns = v.messages(spark, sf).select(
        F.lit("messages").alias("source"), F.col("created_at").alias("t")
    )
    return (
        calls.unionByName(turns)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_at"), F.max("t").alias("last_at"))
    )


# Decode, validate, reject


def _checked(spark, sf):
    return decode.fit_to_log(decode.decode_events(v.payloads(spark, sf)))


@query
def decode_accepted(spark, sf):
    """Typed fields of every payload that passes."""
    accepted, _ = decode.split_rejects(_checked(spark, sf))
    derived = F.col("offset") % v.ODDITIES == 5
    return accepted.select(
        "offset",
        F.when(derived & F.col("event_id").isNotNull(), "derived")
        .otherwise(F.col("event_id"))
        .alias("event_id"),
        "request_id",
        "conversation_id",
        "provider",
        "model",
        timing.epoch_to_timestamp(F.col("started_at")).alias("started_at"),
        timing.epoch_to_timestamp(F.col("completed_at")).alias("completed_at"),
        "duration_ms",
        "tokens_in",
        "tokens_out",
        "status",
        "blocked",
        "streamed",
        "stream_chunks",
        "prompt_preview",
        "metadata",
    )


@query
def decode_rejected(spark, sf):
    """Dead letters with their reason."""
    _, rejected = decode.split_rejects(_checked(spark, sf))
    return rejected.select("offset", "reject_reason")


@query
def reject_summary(spark, sf):
    """Payloads by outcome; the counts add up to the input."""
    return (
        _checked(spark, sf)
        .groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def unknown_conversations(spark, sf):
    """Payloads that fail only because their conversation does not exist."""
    known = v.conversation_rows(spark, sf).select(
        v.uuid_of("conversation-", F.col("conversation_id")).alias("conversation_id")
    )
    decoded = decode.stored_once(_checked(spark, sf).select("offset", "conversation_id", "reject_reason"), "unknown")
    checked = decode.check_conversations(decoded, known)
    return checked.where(F.col("reject_reason") == "conversation_id: unknown").select(
        "offset", "conversation_id"
    )


@query
def readmitted_events(spark, sf):
    """Rejected payloads that pass once their conversation is there."""
    known = v.conversation_rows(spark, sf).select(
        v.uuid_of("conversation-", F.col("conversation_id")).alias("conversation_id")
    )
    decoded = decode.stored_once(_checked(spark, sf).select("offset", "payload", "conversation_id", "reject_reason"), "letters")
    checked = decode.stored_once(decode.check_conversations(decoded, known).where(F.col("reject_reason").isNotNull()), "rejected")
    late = checked.where(F.col("reject_reason") == "conversation_id: unknown").select("conversation_id")
    added = known.union(late.where(F.substring("conversation_id", 1, 1).isin(*"01234567")))
    again, kept = decode.readmit(checked.select("offset", "payload", "reject_reason"), added)
    return (
        again.select("offset", F.lit("again").alias("outcome"))
        .union(kept.select("offset", F.lit("kept").alias("outcome")))
    )


@query
def referential_split(spark, sf):
    """Calls with and without an existing conversation."""
    calls = v.inference_events(spark, sf).withColumn(
        "reject_reason", F.lit(None).cast("string")
    )
    checked = decode.check_conversations(calls, v.conversation_rows(spark, sf))
    return checked.groupBy(F.col("reject_reason").isNull().alias("kept")).agg(
        F.count(F.lit(1)).alias("n"), F.count("conversation_id").alias("with_conversation")
    )


@query
def publish_roundtrip(spark, sf):
    """Accepted events back to wire JSON and decoded again."""
    accepted, _ = decode.split_rejects(_checked(spark, sf))
    wire = decode.to_wire(accepted.drop("offset"))
    again = decode.decode_events(
        wire.select("key", F.col("value").alias("payload"))
    ).where(F.col("reject_reason").isNull() & (F.col("key") == F.col("event_id")))
    return again.groupBy("provider", "status").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("tokens_in").cast("long").alias("tokens_in"),
        F.sum("duration_ms").cast("long").alias("duration_ms"),
        F.sum(F.length("prompt_preview")).cast("long").alias("preview_chars"),
    )


# Enrichment


@query
def derived_timings(spark, sf):
    """Latencies and rates recomputed from epoch seconds."""
    calls = v.inference_events(spark, sf)
    first_token = v.plus_seconds(F.col("started_at"), F.col("ttft_ms") / 1000)
    wire = calls.select(
        "event_id",
        timing.timestamp_to_epoch(F.col("started_at")).alias("started_at"),
        timing.timestamp_to_epoch(first_token).alias("first_token_at"),
        timing.timestamp_to_epoch(F.col("completed_at")).alias("completed_at"),
        F.lit(None).cast("int").alias("duration_ms"),
        F.lit(None).cast("int").alias("ttft_ms"),
        F.lit(None).cast("decimal(10,2)").alias("tokens_per_second"),
        "tokens_out",
    )
    return enrich.derive_timings(wire).select(
        "event_id",
        timing.epoch_to_timestamp(F.col("completed_at")).alias("completed_at"),
        "duration_ms",
        "ttft_ms",
        F.col("tokens_per_second").cast("double").alias("tokens_per_second"),
    )


@query
def priced_events(spark, sf):
    """Cost of every call."""
    return v.inference_logs(spark, sf).select(
        "event_id", "model", F.col("estimated_cost_usd").cast("double").alias("cost_usd")
    )


@query
def redacted_documents(spark, sf):
    """Whole document texts with personal data replaced."""
    docs = v.table(spark, sf, "documents")
    clean = docs.select("doc_id", "text", pii.redact(F.col("text")).alias("redacted"))
    return clean.select(
        "doc_id", "redacted", pii.was_redacted(F.col("text"), F.col("redacted")).alias("pii_found")
    )


@query
def enriched_calls(spark, sf):
    """The standard chain (rules, redaction, pricing) over calls with previews."""
    calls = v.inference_events(spark, sf, previews=True).select(
        "event_id",
        "provider",
        "model",
        "tokens_in",
        "tokens_out",
        F.coalesce("prompt_preview", F.lit("")).alias("prompt_preview"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("re: "), F.coalesce("prompt_preview", F.lit(""))))
        .when(F.col("event_id") % 7 == 0, F.lit("mail x.y@example.org"))
        .otherwise(F.lit(""))
        .alias("response_preview"),
        F.when(F.col("event_id") % 17 == 0, F.lit('{"pii_detected":true}'))
        .when(F.col("event_id") % 17 == 1, F.lit('{"pii_detected":false}'))
        .when(F.col("event_id") % 17 == 2, F.lit('{"k":1}'))
        .otherwise(F.lit("{}"))
        .alias("metadata"),
    )
    chain = [
        enrich.business_rules,
        enrich.redact_previews,
        enrich.price_stage(load_prices(spark)),
    ]
    done = enrich.enrich(calls, chain)
    return done.select(
        "event_id",
        "prompt_preview",
        "response_preview",
        "pii_detected",
        "metadata",
        F.col("estimated_cost_usd").cast("double").alias("cost_usd"),
    )


# Chunks


def _chunks(spark, sf):
    return ch.normalise_lines(v.stream_lines(spark, sf))


@query
def chunk_types(spark, sf):
    """Normalised chunks per provider and type."""
    providers = v.assistant_turns(spark, sf).select("request_id", "provider")
    return (
        _chunks(spark, sf)
        .groupBy("request_id", "type")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(providers, "request_id")
        .groupBy("provider", "type")
        .agg(F.sum("n").alias("n"))
    )


@query
def normalised_chunks(spark, sf):
    """Every chunk of every dialect."""
    return _chunks(spark, sf).select(
        "request_id", "seq", "part", "type", "content", "input_tokens", "output_tokens"
    )


@query
def classified_responses(spark, sf):
    """Whole responses unpacked and classified."""
    return ch.classify_responses(v.responses(spark, sf))


def _response_requests(spark, sf):
    """The calls behind the whole responses; each took a second per ten characters of reply."""
    prompts = conv.call_prompts(v.messages(spark, sf))
    turns = v.assistant_turns(spark, sf).join(prompts, ["conversation_id", "seq"])
    began = timing.timestamp_to_epoch(F.col("created_at"))
    return turns.select(
        F.concat(F.lit("e-"), "request_id").alias("event_id"),
        "request_id",
        F.col("conversation_id").cast("string").alias("conversation_id"),
        "provider",
        F.lit("asked").alias("model"),
        began.alias("started_at"),
        (began + F.floor(F.length("content") / 10)).alias("completed_at"),
        text.preview(F.coalesce("prompt", F.lit(""))).alias("prompt_preview"),
    )


@query
def response_events(spark, sf):
    """Events of calls that were answered in one piece."""
    events = ch.response_events(_response_requests(spark, sf), v.responses(spark, sf))
    return events.select(
        "event_id", "provider", "model", "status", "streamed", "duration_ms", "tokens_in", "tokens_out",
        "error_message", "prompt_preview", "response_preview",
    )


@query
def call_prompts(spark, sf):
    """What the prompt preview of every call is cut from."""
    return conv.call_prompts(v.messages(spark, sf))


@query
def gemini_requests(spark, sf):
    """Conversations in Gemini's request vocabulary."""
    return ch.gemini_messages(v.messages(spark, sf)).select(
        "conversation_id", "seq", "role", "content"
    )


def _stream_chunks(spark, sf):
    return _chunks(spark, sf).unionByName(v.control_chunks(spark, sf))


@query
def chunk_validity(spark, sf):
    """Chunks of known and unknown type after one type is renamed."""
    odd = F.when(F.col("type") == "error", "oops").otherwise(F.col("type"))
    known, other = ch.valid_chunks(_stream_chunks(spark, sf).withColumn("type", odd))
    rows = known.withColumn("known", F.lit(True)).unionByName(other.withColumn("known", F.lit(False)))
    return rows.groupBy("known", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_summaries(spark, sf):
    """First-token time, counts, usage and outcome per stream."""
    return ch.summarise_streams(_stream_chunks(spark, sf)).select(
        "request_id",
        "first_token_ts",
        "last_ts",
        "stream_chunks",
        "tokens_in",
        "tokens_out",
        ch.terminal_status().alias("status"),
        "error_message",
    )


@query
def assembled_events(spark, sf):
    """Stream events with previews and derived timings."""
    turns = v.assistant_turns(spark, sf).select(
        F.col("request_id").alias("event_id"),
        "request_id",
        "conversation_id",
        "provider",
        F.lit("m").alias("model"),
        timing.timestamp_to_epoch(F.col("created_at")).alias("started_at"),
        text.preview(F.col("content")).alias("prompt_preview"),
    )
    return ch.assemble_events(turns, _stream_chunks(spark, sf)).select(
        "request_id",
        "provider",
        "status",
        "duration_ms",
        "ttft_ms",
        "stream_chunks",
        "tokens_in",
        "tokens_out",
        "response_preview",
    )


@query
def assembled_replies(spark, sf):
    """Stored assistant messages rebuilt from their chunks."""
    return ch.assistant_messages(_stream_chunks(spark, sf)).select(
        "request_id", "content", "status"
    )


# Rollup


@query
def hourly_rollup(spark, sf):
    return rollup.hourly_rollup(v.inference_logs(spark, sf))


@query
def rollup_merge(spark, sf):
    """First half of the month as stored, second half as a batch, merged."""
    logs = v.inference_logs(spark, sf)
    early = F.col("created_at") < F.lit("2024-01-15 00:30:00").cast("timestamp")
    return rollup.merge_rollups(
        rollup.hourly_rollup(logs.where(early)), rollup.hourly_rollup(logs.where(~early))
    )


@query
def rollup_rebuild(spark, sf):
    """Rollup of a replayed stream, rebuilt from the deduplicated log."""
    once = matching.first_arrivals(v.replayed(v.inference_logs(spark, sf)), "delivery")
    return rollup.hourly_rollup(once)


@query
def five_minute_latency(spark, sf):
    return rollup.rollup_by_bucket(v.inference_logs(spark, sf))


# Dashboard metrics


def _rollup(spark, sf):
    return rollup.hourly_rollup(v.inference_logs(spark, sf))


def _stream_spans(spark, sf):
    """Every call as a stream that ends a day after completion when its id is a multiple of 3."""
    calls = v.inference_events(spark, sf)
    starts = calls.select(F.col("event_id").alias("request_id"), "started_at")
    slow = F.when(F.col("event_id") % 3 == 0, 86_400).otherwise(0)
    ends = calls.select(
        F.col("event_id").alias("request_id"),
        v.plus_seconds(F.col("completed_at"), slow).alias("ended_at"),
    )
    return starts, ends


@query
def overview(spark, sf):
    starts, ends = _stream_spans(spark, sf)
    live = matching.active_streams(starts, ends, v.AS_OF)
    return metrics.overview(_rollup(spark, sf), "30d", v.AS_OF, live)


@query
def timeseries(spark, sf):
    return metrics.timeseries(_rollup(spark, sf), "30d", v.AS_OF)


@query
def requests_by_status(spark, sf):
    return metrics.requests_by_status(_rollup(spark, sf), "30d", v.AS_OF)


@query
def provider_breakdown(spark, sf):
    return metrics.by_provider(_rollup(spark, sf), "30d", v.AS_OF)


@query
def latency_percentiles(spark, sf):
    return metrics.percentiles(v.inference_logs(spark, sf), "30d", v.AS_OF)


@query
def latency_percentiles_24h(spark, sf):
    return metrics.percentiles(v.inference_logs(spark, sf), "24h", v.AS_OF)


@query
def overview_24h(spark, sf):
    return metrics.overview(_rollup(spark, sf), "24h", v.AS_OF)


@query
def provider_latency(spark, sf):
    return metrics.provider_latency(v.inference_logs(spark, sf))


@query
def provider_tokens(spark, sf):
    return metrics.provider_tokens(v.inference_logs(spark, sf))


@query
def provider_cost(spark, sf):
    return metrics.provider_cost(v.inference_logs(spark, sf))


@query
def stream_metrics(spark, sf):
    starts, ends = _stream_spans(spark, sf)
    live = matching.active_streams(starts, ends, v.AS_OF)
    return metrics.stream_metrics(v.inference_logs(spark, sf), live)


@query
def request_metrics(spark, sf):
    return metrics.request_metrics(v.inference_logs(spark, sf))


@query
def blocked_by_reason(spark, sf):
    return metrics.blocked_by_reason(v.inference_logs(spark, sf))


@query
def latency_sketch(spark, sf):
    """Hourly sketches merged per provider; whether p50, p95 and p99 are within 2 % in rank."""
    logs = v.inference_logs(spark, sf).withColumn(
        "hour", timing.hour_bucket(F.col("completed_at"))
    )
    hourly = percentiles.latency_sketches(logs, ["hour", "provider"], k=400)
    merged = percentiles.merge_sketches(hourly, ["provider"])
    reads = percentiles.sketch_quantiles(merged, metrics.PERCENTILES)
    sample = logs.where(F.col("status") == "success")
    hist = percentiles.value_histogram(sample, "duration_ms", ["provider"])
    below = {
        name: F.sum(F.when(F.col("v") <= F.col(name), F.col("h.n")).otherwise(0)) / F.max("r.n")
        for name in metrics.PERCENTILES
    }
    ranks = (
        hist.alias("h")
        .join(reads.alias("r"), "provider")
        .groupBy("provider")
        .agg(F.max("r.n").alias("n"), *[b.alias(name) for name, b in below.items()])
    )
    close = [
        (F.abs(F.col(name) - p) < 0.02).alias(f"{name}_close")
        for name, p in metrics.PERCENTILES.items()
    ]
    return ranks.select("provider", "n", *close)


# Log reports


@query
def recent_logs(spark, sf):
    return log_reports.recent_logs(v.inference_logs(spark, sf), 50)


@query
def recent_logs_filtered(spark, sf):
    return log_reports.recent_logs(
        v.inference_logs(spark, sf), 500, status="success", provider="openai"
    )


@query
def recent_logs_serialised(spark, sf):
    rows = log_reports.recent_logs(v.inference_logs(spark, sf), 100, status="error")
    return log_reports.serialise_logs(rows)


@query
def blocked_events(spark, sf):
    return log_reports.blocked_events(v.inference_logs(spark, sf)).select(
        "event_id", "provider", "model", "block_reason", "created_at"
    )


@query
def recent_buffer(spark, sf):
    calls = v.inference_events(spark, sf).withColumn("emitted_at", F.col("completed_at"))
    return log_reports.recent_buffer(calls).select("event_id", "emitted_at", "status")


@query
def conversation_list(spark, sf):
    rows = v.conversation_rows(spark, sf)
    return log_reports.list_conversations(rows, "user-3", 50, "2024-01-02 06:00:00")


# Governance


@query
def rate_limited(spark, sf):
    """Two calls per user and day; the rest is over the limit."""
    calls = v.inference_events(spark, sf).select("event_id", "user_id", "started_at")
    marked = governance.flag_rate_limited(
        calls, limit=2, bucket_seconds=86_400, key="user_id", order=("started_at", "event_id")
    )
    return marked.select("event_id", "rate_bucket", "over_rate")


@query
def token_budget(spark, sf):
    return governance.flag_over_budget(v.told_messages(spark, sf), max_tokens=200)


@query
def budget_by_words(spark, sf):
    """Decisions with another estimate, a token for every three characters, and a shorter history."""
    return governance.govern(
        v.turn_requests(spark, sf),
        v.messages(spark, sf),
        limit=1,
        bucket_seconds=120,
        max_tokens=200,
        history=2,
        estimate=lambda chars: F.floor(chars / 3).cast("long"),
    ).select("request_id", "context_tokens", "block_reason")


def _governed(spark, sf):
    return governance.govern(
        v.turn_requests(spark, sf),
        v.messages(spark, sf),
        limit=1,
        bucket_seconds=120,
        max_tokens=200,
    )


@query
def governance_decisions(spark, sf):
    return _governed(spark, sf).select("request_id", "over_rate", "block_reason")


@query
def blocked_call_events(spark, sf):
    """The log events of blocked user turns."""
    events = governance.blocked_events(_governed(spark, sf), limit=1, max_tokens=200)
    return events.select(
        "request_id",
        "conversation_id",
        "provider",
        "model",
        timing.epoch_to_timestamp(F.col("started_at")).alias("started_at"),
        timing.epoch_to_timestamp(F.col("completed_at")).alias("completed_at"),
        "duration_ms",
        "tokens_in",
        "status",
        "blocked",
        "block_reason",
        "error_message",
        "prompt_preview",
    )


@query
def merged_event_stream(spark, sf):
    """Assembled provider calls and blocked calls as one stream, counted."""
    turns = v.assistant_turns(spark, sf).select(
        F.col("request_id").alias("event_id"),
        "request_id",
        F.col("conversation_id").cast("string").alias("conversation_id"),
        "provider",
        F.lit("m").alias("model"),
        timing.timestamp_to_epoch(F.col("created_at")).alias("started_at"),
        F.lit("").alias("prompt_preview"),
    )
    calls = ch.assemble_events(turns, _stream_chunks(spark, sf))
    blocked = governance.blocked_events(_governed(spark, sf), limit=1, max_tokens=200)
    whole = ch.response_events(_response_requests(spark, sf), v.responses(spark, sf))
    return (
        governance.merge_event_streams(calls, blocked, whole)
        .groupBy("streamed", "status", "blocked")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Conversations


@query
def message_history(spark, sf):
    """The last three messages of every conversation."""
    return conv.history(v.told_messages(spark, sf), 3).select(
        "conversation_id", "seq", "role", "content", "status"
    )


@query
def one_conversation(spark, sf):
    """The last four messages of one conversation, as its page shows them."""
    rows = v.told_messages(spark, sf)
    return conv.one_history(rows, 3, 4).select("conversation_id", "seq", "role", "content", "status")


@query
def context_windows(spark, sf):
    """Prompt contexts of up to three earlier messages, as text."""
    built = conv.context_windows(v.told_messages(spark, sf), 3)
    return built.select(
        "conversation_id",
        "seq",
        F.size("context").alias("n_messages"),
        F.array_join(
            F.transform("context", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"
        ).alias("context"),
    )


@query
def prompt_sources(spark, sf):
    return conv.prompt_sources(v.messages(spark, sf)).select(
        "conversation_id", "seq", text.preview(F.col("content")).alias("prompt_preview")
    )


@query
def message_order(spark, sf):
    """Messages numbered by creation time when replies carry their stream's start."""
    return conv.number_messages(v.told_messages(spark, sf)).select(
        "conversation_id", "seq", "position"
    )


@query
def conversation_table(spark, sf):
    return v.conversation_rows(spark, sf)


@query
def conversation_messages(spark, sf):
    joined = conv.conversation_messages(v.conversation_rows(spark, sf), v.messages(spark, sf))
    return joined.select("conversation_id", "seq", "role", "content", "title", "user_id")


@query
def usage_by_user(spark, sf):
    return matching.usage_by_user(v.inference_logs(spark, sf), v.conversation_rows(spark, sf))


def _deleted(spark, sf):
    return v.conversation_rows(spark, sf).where(F.col("conversation_id") % 4 == 1)


@query
def cascade_delete(spark, sf):
    """Messages left after a quarter of the conversations is deleted."""
    return conv.cascade_delete(v.messages(spark, sf), _deleted(spark, sf)).select(
        "conversation_id", "seq", "role", "status"
    )


@query
def detach_deleted(spark, sf):
    """Log rows after the same deletion: all of them, some without their conversation."""
    return conv.detach_deleted(v.inference_logs(spark, sf), _deleted(spark, sf)).select(
        "event_id", "conversation_id"
    )


@query
def create_missing(spark, sf):
    """Conversations after a batch of calls created the ones it referred to."""
    ids = v.inference_events(spark, sf).where(F.col("conversation_id").isNotNull())
    at = F.lit(v.AS_OF).cast("timestamp")
    return conv.create_missing(v.conversation_rows(spark, sf), ids, at)


@query
def append_messages(spark, sf):
    """Messages after every conversation got a closing user message."""
    rows = v.messages(spark, sf)
    closing = rows.groupBy("conversation_id").agg(
        (F.max("seq") + 1).alias("seq"),
        v.plus_seconds(F.max("created_at"), F.lit(30)).alias("created_at"),
    )
    new = closing.select(
        "*", F.lit("user").alias("role"), F.lit("thanks, that is all").alias("content")
    )
    return conv.append_messages(rows, new).select(
        "conversation_id", "seq", "role", "content", "status", "created_at"
    )


def updates_from_calls(spark, sf):
    """Touches from calls, new titles and cancellations."""
    calls = v.inference_events(spark, sf).where(F.col("conversation_id").isNotNull())
    retitled = F.col("event_id") % 5 == 0
    return calls.select(
        "conversation_id",
        "event_id",
        F.col("created_at").alias("changed_at"),
        F.when(
            retitled, F.concat(F.lit("call "), F.col("event_id").cast("string"))
        ).alias("title"),
        F.when(F.col("status") == "cancelled", "cancelled").alias("status"),
        (F.col("event_id") % 2 == 0).alias("touch"),
    )


@query
def conversation_updates(spark, sf):
    """Those changes merged into the conversations."""
    return conv.apply_updates(v.conversation_rows(spark, sf), updates_from_calls(spark, sf).drop("event_id"))


@query
def evolved_columns(spark, sf):
    """Messages of an older layout without a status, read with its default."""
    rows = v.messages(spark, sf)
    path = scratch_dir(spark, "evolved")
    rows.where(F.col("seq") < 2).drop("status").write.parquet(path)
    rows.where(F.col("seq") >= 2).write.mode("append").parquet(path)
    return (
        conv.read_evolved(spark, path, {"status": "completed", "blocked_count": 0})
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("blocked_count").alias("blocked_count"))
    )


# Matching


@query
def first_deliveries(spark, sf):
    """A replayed stream collapsed to first deliveries."""
    return matching.first_arrivals(v.replayed(v.inference_events(spark, sf)), "delivery").select(
        "event_id", "delivery", "status", "duration_ms"
    )


@query
def unseen_events(spark, sf):
    """Replayed deliveries the log does not hold yet, the log being the first three weeks."""
    calls = v.inference_events(spark, sf)
    stored = calls.where(F.col("created_at") < F.lit("2024-01-22").cast("timestamp"))
    batch = v.replayed(calls).select("event_id", "delivery", "created_at")
    return matching.unseen(batch, stored)


@query
def active_streams(spark, sf):
    starts, ends = _stream_spans(spark, sf)
    return matching.active_streams(starts, ends, v.AS_OF, ttl_seconds=6 * 3600)


@query
def cancel_matches(spark, sf):
    """Cancels, some late and some malformed, matched to open streams."""
    starts, ends = _stream_spans(spark, sf)
    request = v.uuid_of("request-", F.col("request_id"))
    streams = starts.join(ends, "request_id").withColumn("request_id", request)
    asked = v.plus_seconds(F.col("started_at"), F.col("event_id") % 7)
    calls = v.inference_events(spark, sf)
    notes = calls.select(
        F.when(F.col("event_id") % 10 == 9, F.lit("garbage"))
        .otherwise(v.uuid_of("request-", F.col("event_id")))
        .alias("payload"),
        asked.alias("cancel_ts"),
    )
    good, _ = matching.parse_cancels(notes)
    return matching.match_cancels(good, streams)


@query
def malformed_cancels(spark, sf):
    """Cancel notes that name no request."""
    calls = v.inference_events(spark, sf)
    notes = calls.select(
        "event_id",
        F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("garbage-"), F.col("status")))
        .otherwise(v.uuid_of("request-", F.col("event_id")))
        .alias("payload"),
    )
    _, bad = matching.parse_cancels(notes)
    return bad
