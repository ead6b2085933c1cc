"""Engine inputs derived from the test tables.

The test tables hold no inference calls, so every input is a projection of `events`,
`documents` or `conversations`; each grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.identity import dashed
from callscope.functions.timing import tokens_per_second
from callscope.operators.enrich import price_events
from callscope.sources.lookups import load_prices, load_registry
from callscope.sources.tables import scan

AS_OF = "2024-01-30 12:30:00"
EPOCH_START = "2024-01-01 00:00:00"
# Every 101 events, one of each of these wire oddities.
ODDITIES = 101


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet")


def uuid_of(prefix: str, number: Column) -> Column:
    return dashed(F.md5(F.concat(F.lit(prefix), number.cast("string"))))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.round(seconds * F.lit(1e6)).cast("long"))


def inference_events(spark: SparkSession, sf_dir: str, previews: bool = False) -> DataFrame:
    """One call per `events` row."""
    events = table(spark, sf_dir, "events")
    if previews:  # few or uneven row groups would leave cores idle while wide rows are made of narrow ones
        # A number of its own, as partitions put together by their few bytes are too few for that work.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        events = events.repartition(tasks, "event_id", "ts")
    registry = load_registry(spark).select(
        (F.col("provider_pos") * 3 + F.col("pos")).alias("_pos"), "provider", "model"
    )
    raw_ms = F.round(F.col("value") * 100).cast("int")
    failed = F.col("event_type") == "error"
    cancelled = F.col("event_type") == "signup"
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    blocked = failed & (F.col("event_id") % 2 == 0)
    base = events.select(
        "event_id",
        (F.col("event_id") % 11).cast("int").alias("_pos"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("conversation_id"),
        F.col("ts").alias("started_at"),
        F.when(failed, "error").when(cancelled, "cancelled").otherwise("success").alias("status"),
        blocked.alias("blocked"),
        F.when(
            blocked,
            F.when(F.col("event_id") % 4 == 0, "rate_limit_exceeded").otherwise(
                "token_budget_exceeded"
            ),
        ).alias("block_reason"),
        F.when(blocked, 0).otherwise(raw_ms).alias("duration_ms"),
        F.when(~failed, F.floor(raw_ms / 4).cast("int")).alias("ttft_ms"),
        F.when(~failed, 50 + 37 * k).alias("tokens_in"),
        F.when(~failed & ~cancelled, F.floor(raw_ms / 20).cast("int")).alias("tokens_out"),
        "user_id",
    )
    timed = base.withColumn(
        "completed_at", plus_seconds(F.col("started_at"), F.col("duration_ms") / 1000)
    ).withColumn("created_at", plus_seconds(F.col("completed_at"), F.col("event_id") % 7200))
    out = timed.join(registry, "_pos").drop("_pos")
    if not previews:
        return out
    documents = table(spark, sf_dir, "documents")
    n_docs = documents.agg(F.count(F.lit(1))).scalar()
    texts = documents.select(
        F.col("doc_id").alias("_doc_id"), F.substring("text", 1, 200).alias("prompt_preview")
    )
    return out.join(texts, F.col("event_id") % n_docs == F.col("_doc_id"), "left").drop("_doc_id")


def inference_logs(spark: SparkSession, sf_dir: str, previews: bool = False) -> DataFrame:
    """Priced calls with their output rate: what the raw log holds."""
    calls = inference_events(spark, sf_dir, previews).withColumn(
        "tokens_per_second", tokens_per_second(F.col("tokens_out"), F.col("duration_ms"))
    )
    return price_events(calls, load_prices(spark))


def replayed(events: DataFrame) -> DataFrame:
    """The calls plus a second delivery of every fiftieth."""
    second = events.where(F.col("event_id") % 50 == 0)
    return events.withColumn("delivery", F.lit(1)).unionByName(
        second.withColumn("delivery", F.lit(2))
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` rows as messages, one every 30 seconds."""
    rows = table(spark, sf_dir, "conversations")
    start = F.lit(EPOCH_START).cast("timestamp")
    interrupted = (F.col("role") == "assistant") & (F.col("conv_id") % 7 == 0)
    return rows.select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("seq"),
        "role",
        F.col("text").alias("content"),
        F.when(interrupted, "interrupted").otherwise("completed").alias("status"),
        plus_seconds(start, F.col("conv_id") * 3600 + F.col("turn") * 30).alias("created_at"),
    )


def told_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose replies carry their stream's start, so they come before what they answer."""
    started = F.when(
        F.col("role") == "assistant", plus_seconds(F.col("created_at"), F.lit(-40))
    ).otherwise(F.col("created_at"))
    return messages(spark, sf_dir).withColumn("created_at", started)


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, owned by ten users in turn."""
    from callscope.operators.conversations import conversation_table

    owner = F.concat(F.lit("user-"), (F.col("conversation_id") % 10).cast("string"))
    return conversation_table(messages(spark, sf_dir), owner)


def turn_id() -> Column:
    return F.concat(
        F.lit("c"), F.col("conversation_id").cast("string"), F.lit("-t"), F.col("seq").cast("string")
    )


def turn_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per user turn."""
    registry = load_registry(spark).select(
        (F.col("provider_pos") * 3 + F.col("pos")).alias("_pos"), "provider", "model"
    )
    user = messages(spark, sf_dir).where(F.col("role") == "user")
    return (
        user.withColumn("request_id", turn_id())
        .withColumn("_pos", (F.col("conversation_id") % 11).cast("int"))
        .join(registry, "_pos")
        .select(
            "conversation_id",
            "seq",
            "request_id",
            F.col("created_at").alias("started_at"),
            "provider",
            "model",
            "content",
        )
    )


def _provider_of_turn() -> Column:
    names = F.array(*[F.lit(p) for p in ("anthropic", "openai", "gemini", "llama")])
    return F.element_at(names, (F.col("conversation_id") % 4 + 1).cast("int"))


def assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        messages(spark, sf_dir)
        .where(F.col("role") == "assistant")
        .withColumn("request_id", turn_id())
        .withColumn("provider", _provider_of_turn())
    )


def _token_json(provider: Column, word: Column) -> Column:
    text = F.struct(word.alias("text"))
    anthropic = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), text.alias("delta")))
    openai = F.to_json(
        F.struct(
            F.array(F.struct(F.struct(word.alias("content")).alias("delta"))).alias("choices")
        )
    )
    gemini = F.to_json(
        F.struct(
            F.array(
                F.struct(F.struct(F.array(text).alias("parts")).alias("content"))
            ).alias("candidates")
        )
    )
    return (
        F.when(provider == "anthropic", anthropic).when(provider == "gemini", gemini).otherwise(openai)
    )


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant text as the lines its provider would have streamed.

    One line per word; the frame lines carry input tokens 50 + seq and as many output tokens as
    there are words.  A comment line and an unparsable line are mixed in.
    """
    turns = assistant_turns(spark, sf_dir).withColumn("words", F.split("content", " "))
    n = F.size("words")
    provider = F.col("provider")
    word = F.when(F.col("w_pos") > 0, F.concat(F.lit(" "), F.col("word"))).otherwise(F.col("word"))
    tokens_in, tokens_out = (50 + F.col("seq")).cast("string"), n.cast("string")

    def line(offset: Column, text: Column) -> Column:
        return F.struct(offset.cast("long").alias("line_seq"), text.alias("line"))

    anthropic_start = F.concat(
        F.lit('{"type":"message_start","message":{"usage":{"input_tokens":'), tokens_in, F.lit("}}}")
    )
    anthropic_usage = F.concat(
        F.lit('{"type":"message_delta","usage":{"output_tokens":'), tokens_out, F.lit("}}")
    )
    openai_usage = F.concat(
        F.lit('{"choices":[{"delta":{},"finish_reason":"stop"}],"usage":{"prompt_tokens":'),
        tokens_in,
        F.lit(',"completion_tokens":'),
        tokens_out,
        F.lit("}}"),
    )
    gemini_end = F.concat(
        F.lit('{"candidates":[{"content":{"parts":[]},"finishReason":"STOP"}],"usageMetadata":'
              '{"promptTokenCount":'),
        tokens_in,
        F.lit(',"candidatesTokenCount":'),
        tokens_out,
        F.lit("}}"),
    )
    data = F.lit("data: ")
    frame = F.array(
        line(F.lit(0), F.lit(": keep-alive")),
        line(F.lit(0), F.lit('data: {"broken')),
        F.when(provider == "anthropic", line(F.lit(1), F.concat(data, anthropic_start))),
        F.when(provider == "anthropic", line(n + 10, F.concat(data, anthropic_usage))),
        F.when(
            provider == "anthropic", line(n + 11, F.lit('data: {"type":"message_stop"}'))
        ),
        F.when(provider == "openai", line(n + 10, F.concat(data, openai_usage))),
        F.when(provider == "openai", line(n + 11, F.lit("data: [DONE]"))),
        F.when(provider == "gemini", line(n + 10, F.concat(data, gemini_end))),
        F.when(
            provider == "llama",
            line(n + 10, F.lit('data: {"choices":[{"finish_reason":"stop"}]}')),
        ),
    )
    keys = ["request_id", "provider", "created_at"]
    word_lines = turns.select(*keys, F.posexplode("words").alias("w_pos", "word")).select(
        *keys,
        (F.col("w_pos") + 2).cast("long").alias("line_seq"),
        F.concat(data, _token_json(provider, word)).alias("line"),
    )
    frame_lines = turns.select(
        *keys, F.explode(F.filter(frame, lambda x: x.isNotNull())).alias("f")
    ).select(*keys, "f.line_seq", "f.line")
    return word_lines.unionByName(frame_lines).select(
        "request_id",
        "provider",
        F.col("line_seq").alias("seq"),
        plus_seconds(F.col("created_at"), F.col("line_seq") / 20).alias("ts"),
        "line",
    )


def control_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chat service adds to a stream: some cancels, some failures, at its end."""
    turns = assistant_turns(spark, sf_dir)
    conv = F.col("conversation_id")
    kind = F.when(conv % 5 == 3, "cancelled").when(conv % 11 == 7, "error")
    end = F.size(F.split("content", " ")) + 20
    none = F.lit(None)
    return turns.where(kind.isNotNull()).select(
        "request_id",
        end.cast("long").alias("seq"),
        F.lit(0).alias("part"),
        plus_seconds(F.col("created_at"), end / 20).alias("ts"),
        kind.alias("type"),
        none.cast("string").alias("content"),
        F.when(kind == "error", "upstream reset").alias("error"),
        none.cast("int").alias("input_tokens"),
        none.cast("int").alias("output_tokens"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant text as one whole provider response; some failed, some empty."""
    turns = assistant_turns(spark, sf_dir)
    conv, provider, seq = F.col("conversation_id"), F.col("provider"), F.col("seq")
    text = F.col("content")
    n_in, n_out = (50 + seq).cast("int"), F.length(text)
    usage = F.struct(n_in.alias("input_tokens"), n_out.alias("output_tokens"))
    anthropic = F.to_json(
        F.struct(
            F.lit("served").alias("model"),
            F.array(F.struct(text.alias("text"))).alias("content"),
            usage.alias("usage"),
        )
    )
    counts = F.struct(n_in.alias("prompt_tokens"), n_out.alias("completion_tokens"))
    message = F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")
    openai = F.to_json(F.struct(message, counts.alias("usage")))
    llama = F.to_json(F.struct(message))
    parts = F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))
    gemini = F.to_json(
        F.struct(
            F.array(F.struct(parts.alias("content"))).alias("candidates"),
            F.struct(
                n_in.alias("promptTokenCount"), n_out.alias("candidatesTokenCount")
            ).alias("usageMetadata"),
        )
    )
    body = (
        F.when(provider == "anthropic", anthropic)
        .when(provider == "openai", openai)
        .when(provider == "gemini", gemini)
        .otherwise(llama)
    )
    return turns.select(
        "request_id",
        "provider",
        F.lit("asked").alias("model"),
        F.when(conv % 9 == 4, 500).otherwise(200).alias("status_code"),
        F.when(conv % 9 == 4, "upstream failed")
        .when(conv % 13 == 5, "")
        .otherwise(body)
        .alias("body"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls as wire JSON, with the oddities of real traffic by `event_id % 101`."""
    calls = inference_events(spark, sf_dir, previews=True)
    odd = (F.col("event_id") % ODDITIES).cast("int")

    def epoch(ts: str) -> Column:
        return F.unix_micros(ts) / F.lit(1e6)

    request = uuid_of("request-", F.col("event_id"))
    conversation = F.when(
        F.col("conversation_id").isNotNull(), uuid_of("conversation-", F.col("conversation_id"))
    )
    document = F.to_json(
        F.struct(
            uuid_of("event-", F.col("event_id")).alias("event_id"),
            F.when(odd == 6, F.upper(F.regexp_replace(request, "-", "")))
            .otherwise(request)
            .alias("request_id"),
            conversation.alias("conversation_id"),
            "provider",
            "model",
            epoch("started_at").alias("started_at"),
            epoch("completed_at").alias("completed_at"),
            "duration_ms",
            "ttft_ms",
            "tokens_in",
            "tokens_out",
            "status",
            "blocked",
            "block_reason",
            F.lit(0).alias("stream_chunks"),
            "prompt_preview",
        ),
        {"ignoreNullFields": "false"},
    )
    # One replacement per oddity: pattern and what stands in its place.
    edits = {
        1: ('"provider":"[^"]*",', ""),
        2: ('"tokens_in":([0-9]+)', '"tokens_in":"$1"'),
        3: ('"status":"[^"]*"', '"status":"weird"'),
        4: ("[}]$", ',"surprise":{"x":1}}'),
        5: ('"event_id":"[^"]*",', ""),
        7: ('"tokens_out":[0-9nul]+', '"tokens_out":12.5'),
        8: ('"started_at":[^,]*', '"started_at":null'),
        9: ('"model":"[^"]*"', '"model":123'),
        11: ('"tokens_in":[0-9nul]+', '"tokens_in":3000000000'),
        12: ("[}]$", ',"metadata":[1,2]}'),
        13: ('"conversation_id":[^,]*', '"conversation_id":"not-a-uuid"'),
        14: ('"stream_chunks":0', '"stream_chunks":null'),
        15: (',"prompt_preview":.*[}]$', "}"),
        16: ("[}]$", ',"metadata":{"pii_detected":true}}'),
        17: ("[}]$", ',"metadata":{"region":"eu","pii_detected":false}}'),
    }
    yes_no = F.when(F.col("blocked"), '"blocked":"yes"').otherwise('"blocked":"no"')
    pattern = F.when(odd == 10, '"blocked":(?:true|false)')
    put = F.when(odd == 10, yes_no)
    for k, (old, new) in edits.items():
        pattern, put = pattern.when(odd == k, old), put.when(odd == k, new)
    edited = F.when(pattern.isNull(), F.col("document")).otherwise(
        F.regexp_replace("document", pattern, put)
    )
    return calls.select("event_id", "provider", "blocked", document.alias("document")).select(
        F.col("event_id").alias("offset"),
        F.when(odd == 0, F.substring("document", 1, 60)).otherwise(edited).alias("payload"),
    )
