"""Provider stream lines to normalised chunks, and chunks to events and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.text import preview
from callscope.operators.enrich import derive_timings
from callscope.operators.keyed import SALTS
from callscope.schemas import CHUNK_TYPES, LOG_EVENT_SCHEMA, PREVIEW_CHARS

_PREFIX = "data: "
_CHUNK = "struct<type:string,content:string,input_tokens:int,output_tokens:int>"

# Where each provider puts its counts and its text in a whole response.
RESPONSE_PATHS = {
    "anthropic": {
        "content": "$.content[0].text",
        "input_tokens": "$.usage.input_tokens",
        "output_tokens": "$.usage.output_tokens",
        "model": "$.model",
    },
    "openai": {
        "content": "$.choices[0].message.content",
        "input_tokens": "$.usage.prompt_tokens",
        "output_tokens": "$.usage.completion_tokens",
        "model": "$.model",
    },
    "gemini": {
        "content": "$.candidates[0].content.parts[0].text",
        "input_tokens": "$.usageMetadata.promptTokenCount",
        "output_tokens": "$.usageMetadata.candidatesTokenCount",
        "model": None,
    },
    "llama": {
        "content": "$.choices[0].message.content",
        "input_tokens": "$.usage.prompt_tokens",
        "output_tokens": "$.usage.completion_tokens",
        "model": "$.model",
    },
}
NO_CONTENT = "No content returned"


def _get(path: str, dtype: str) -> Column:
    return F.try_variant_get("_doc", path, dtype)


def _chunk(kind: str, content=None, tokens_in=None, tokens_out=None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(kind).alias("type"),
        (null if content is None else content).cast("string").alias("content"),
        (null if tokens_in is None else tokens_in).cast("int").alias("input_tokens"),
        (null if tokens_out is None else tokens_out).cast("int").alias("output_tokens"),
    )


def _present(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def _some(*candidates: Column) -> Column:
    """The candidates that are not null, as an array."""
    return F.filter(F.array(*candidates), lambda c: c.isNotNull()).cast(f"array<{_CHUNK}>")


def _anthropic() -> Column:
    kind = _get("$.type", "string")
    text = _get("$.delta.text", "string")
    tokens_in = _get("$.message.usage.input_tokens", "int")
    usage = F.to_json(_get("$.usage", "variant"))
    return _some(
        F.when((kind == "content_block_delta") & _present(text), _chunk("token", text))
        .when(
            (kind == "message_start") & tokens_in.isNotNull(),
            _chunk("metadata", tokens_in=tokens_in),
        )
        .when(
            (kind == "message_delta") & usage.isNotNull() & ~usage.isin("{}", "null"),
            _chunk("metadata", tokens_out=_get("$.usage.output_tokens", "int")),
        )
        .when(kind == "message_stop", _chunk("done"))
    )


def _openai_text() -> Column:
    return _get("$.choices[0].delta.content", "string")


def _done_line() -> Column:
    return F.trim("_body") == "[DONE]"


def _openai() -> Column:
    text = _openai_text()
    tokens_in = _get("$.usage.prompt_tokens", "int")
    tokens_out = _get("$.usage.completion_tokens", "int")
    usage = tokens_in.isNotNull() | tokens_out.isNotNull()
    # Usage counts on whatever line they come, the finishing one or one without choices.
    return _some(
        F.when(_done_line(), _chunk("done"))
        .when(_present(text), _chunk("token", text))
        .when(usage, _chunk("metadata", tokens_in=tokens_in, tokens_out=tokens_out))
    )


def _llama() -> Column:
    text = _openai_text()
    finished = _present(_get("$.choices[0].finish_reason", "string"))
    return _some(
        F.when(_done_line(), _chunk("done"))
        .when(_present(text), _chunk("token", text))
        .when(finished, _chunk("done"))
    )


def _gemini() -> Column:
    text = _get("$.candidates[0].content.parts[0].text", "string")
    answered = _get("$.candidates[0]", "variant").isNotNull()
    finished = _get("$.candidates[0].finishReason", "string").isin("STOP", "MAX_TOKENS")
    tokens_in = _get("$.usageMetadata.promptTokenCount", "int")
    tokens_out = _get("$.usageMetadata.candidatesTokenCount", "int")
    told = F.to_json(_get("$.usageMetadata", "variant"))
    # Any usage that isn't empty counts, also one with neither of the two counts.
    usage = told.isNotNull() & ~told.isin("{}", "null")
    ends = F.coalesce(finished, F.lit(False))
    # One line may carry text, usage and the end at once, in this order.
    return _some(
        F.when(_present(text), _chunk("token", text)),
        F.when(
            usage & (ends | ~answered),
            _chunk("metadata", tokens_in=tokens_in, tokens_out=tokens_out),
        ),
        F.when(ends, _chunk("done")),
    )


DIALECTS = {
    "anthropic": _anthropic,
    "openai": _openai,
    "gemini": _gemini,
    "llama": _llama,
}


def normalise_lines(lines: DataFrame) -> DataFrame:
    """Raw stream lines of any provider to chunks; no shuffle.

    Only `data: ` lines count and lines that do not parse are dropped.  `part` orders the chunks
    that share a line.
    """
    bodies = lines.where(F.startswith("line", F.lit(_PREFIX))).select(
        "request_id",
        "provider",
        "seq",
        "ts",
        F.substring("line", len(_PREFIX) + 1, 2_147_483_647).alias("_body"),
    )
    docs = bodies.withColumn("_doc", F.try_parse_json("_body"))
    by_dialect = F.lit(None).cast(f"array<{_CHUNK}>")
    for provider, dialect in DIALECTS.items():
        by_dialect = F.when(F.col("provider") == provider, dialect()).otherwise(by_dialect)
    return docs.select(
        "request_id", "seq", "ts", F.posexplode(by_dialect).alias("part", "c")
    ).select(
        "request_id",
        "seq",
        "part",
        "ts",
        F.col("c.type").alias("type"),
        F.col("c.content").alias("content"),
        F.lit(None).cast("string").alias("error"),
        F.col("c.input_tokens").alias("input_tokens"),
        F.col("c.output_tokens").alias("output_tokens"),
    )


def valid_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known types, the rest)."""
    known = F.coalesce(F.col("type").isin(*CHUNK_TYPES), F.lit(False))
    return chunks.where(known), chunks.where(~known)


def classify_responses(responses: DataFrame) -> DataFrame:
    """Whole HTTP responses (request_id, provider, model, status_code, body) to results.

    2xx is SUCCESS, the rest ERROR; an empty good body reads "No content returned".  Counts
    default to 0 and the model to the one asked for.
    """
    docs = responses.withColumn("_doc", F.try_parse_json("body"))
    ok = F.col("status_code").between(200, 299)

    def pick(field: str, dtype: str) -> Column:
        out = F.lit(None).cast(dtype)
        for provider, paths in RESPONSE_PATHS.items():
            if paths[field]:
                out = F.when(F.col("provider") == provider, _get(paths[field], dtype)).otherwise(out)
        return out

    empty = F.coalesce(F.col("body") == "", F.lit(True))
    return docs.select(
        "request_id",
        "provider",
        F.when(ok, F.coalesce(pick("model", "string"), F.col("model")))
        .otherwise(F.col("model"))
        .alias("model"),
        F.when(ok, F.lit("SUCCESS")).otherwise(F.lit("ERROR")).alias("action_status"),
        F.when(ok & empty, F.lit(NO_CONTENT)).when(ok, pick("content", "string")).alias("content"),
        F.when(ok, F.coalesce(pick("input_tokens", "int"), F.lit(0))).alias("input_tokens"),
        F.when(ok, F.coalesce(pick("output_tokens", "int"), F.lit(0))).alias("output_tokens"),
        F.when(~ok, F.col("body")).alias("error_message"),
    )


def gemini_messages(messages: DataFrame) -> DataFrame:
    """Messages in Gemini's request vocabulary; roles it does not have are dropped."""
    return messages.where(F.col("role").isin("user", "assistant")).withColumn(
        "role", F.when(F.col("role") == "assistant", F.lit("model")).otherwise(F.lit("user"))
    )


def _order() -> Column:
    return F.struct("seq", "part")


def _has_text() -> Column:
    return (F.col("type") == "token") & _present(F.col("content"))


def response_previews(chunks: DataFrame, chars: int = PREVIEW_CHARS) -> DataFrame:
    """First characters of every response.

    Each kept token adds a character or more, so the first `chars` tokens suffice.  Ranking
    stops there, within salted shares of a request first, so even one endless stream brings no
    task more than SALTS times that many rows.
    """
    share = Window.partitionBy("request_id", "_salt").orderBy("seq", "part")
    whole = Window.partitionBy("request_id").orderBy("seq", "part")
    heads = (
        chunks.where(_has_text())
        .select("request_id", "seq", "part", preview(F.col("content"), chars).alias("content"))
        .withColumn("_salt", F.pmod(F.xxhash64("seq", "part"), F.lit(SALTS)))
        .withColumn("_rn", F.row_number().over(share))
        .where(F.col("_rn") <= chars)
        .withColumn("_rn", F.row_number().over(whole))
        .where(F.col("_rn") <= chars)
    )
    pieces = F.array_sort(F.collect_list(F.struct("_rn", "content")))
    return heads.groupBy("request_id").agg(
        preview(F.array_join(F.transform(pieces, lambda p: p["content"]), ""), chars).alias(
            "response_preview"
        )
    )


def summarise_streams(chunks: DataFrame) -> DataFrame:
    """Counts, times, usage and outcome of every request's chunk stream, combined map-side."""
    kind = F.col("type")
    last_in = F.when(F.col("input_tokens").isNotNull(), _order())
    last_out = F.when(F.col("output_tokens").isNotNull(), _order())
    return chunks.groupBy("request_id").agg(
        F.min(F.when(kind == "token", F.col("ts"))).alias("first_token_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.when(_has_text(), True)).cast("int").alias("stream_chunks"),
        F.max_by("input_tokens", last_in).alias("tokens_in"),
        F.max_by("output_tokens", last_out).alias("tokens_out"),
        F.max(F.when(kind == "cancelled", 1).otherwise(0)).alias("_cancelled"),
        F.max(F.when(kind == "error", 1).otherwise(0)).alias("_failed"),
        F.max_by("error", F.when(kind == "error", _order())).alias("error_message"),
    )


def terminal_status() -> Column:
    """Cancelled, failed or, for a stream that simply ended, success."""
    return (
        F.when(F.col("_cancelled") == 1, F.lit("cancelled"))
        .when(F.col("_failed") == 1, F.lit("error"))
        .otherwise(F.lit("success"))
    )


def assemble_events(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """One streamed-call event per request.

    `requests` has event_id, request_id, conversation_id, provider, model, started_at (epoch
    seconds) and prompt_preview, one row each; both joins are on a key unique on both sides.
    """
    facts = summarise_streams(chunks)
    heads = response_previews(chunks)
    joined = requests.join(facts, "request_id", "left").join(heads, "request_id", "left")
    events = joined.select(
        "event_id",
        "request_id",
        "conversation_id",
        "provider",
        "model",
        "started_at",
        (F.unix_micros("first_token_ts") / F.lit(1e6)).alias("first_token_at"),
        (F.unix_micros("last_ts") / F.lit(1e6)).alias("completed_at"),
        F.lit(None).cast("int").alias("duration_ms"),
        F.lit(None).cast("int").alias("ttft_ms"),
        F.lit(None).cast("decimal(10,2)").alias("tokens_per_second"),
        F.lit(True).alias("streamed"),
        F.coalesce("stream_chunks", F.lit(0)).alias("stream_chunks"),
        "tokens_in",
        "tokens_out",
        F.lit(None).cast("decimal(12,8)").alias("estimated_cost_usd"),
        terminal_status().alias("status"),
        F.lit(None).cast("string").alias("error_code"),
        "error_message",
        "prompt_preview",
        F.coalesce("response_preview", F.lit("")).alias("response_preview"),
        F.lit(False).alias("blocked"),
        F.lit(None).cast("string").alias("block_reason"),
        F.lit("{}").alias("metadata"),
    )
    return derive_timings(events)


def response_events(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One call event per request that was answered in one piece.

    `requests` is as for `assemble_events`, with completed_at (epoch seconds) too; `responses`
    is as for `classify_responses`, one row per request.
    """
    results = classify_responses(responses).select(
        "request_id",
        F.col("model").alias("_served"),
        F.col("action_status").alias("_outcome"),
        F.col("content").alias("_content"),
        F.col("input_tokens").alias("tokens_in"),
        F.col("output_tokens").alias("tokens_out"),
        "error_message",
    )
    good = F.col("_outcome") == "SUCCESS"
    given = {
        "model": F.coalesce("_served", "model"),
        "streamed": F.lit(False),
        "stream_chunks": F.lit(0),
        "status": F.when(good, F.lit("success")).otherwise(F.lit("error")),
        "response_preview": F.coalesce(F.when(good, preview(F.col("_content"))), F.lit("")),
        "blocked": F.lit(False),
        "metadata": F.lit("{}"),
    }
    joined = requests.join(results, "request_id")
    kept = {name: F.col(name) for name in joined.columns}
    events = joined.select(
        *[
            given.get(f.name, kept.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in LOG_EVENT_SCHEMA.fields
        ]
    )
    return derive_timings(events)


def assistant_messages(chunks: DataFrame, segment: int = 4096) -> DataFrame:
    """The stored reply of every request: its tokens joined in order.

    Cancelled streams store what arrived, as interrupted; failed streams and empty completed
    ones store nothing.  Tokens are joined per run of sequence numbers first, so one very long
    stream is spread over tasks and only its pieces meet.
    """
    tokens = chunks.where(_has_text()).withColumn(
        "_run", F.floor(F.col("seq") / F.lit(segment)).cast("long")
    )
    in_run = F.array_sort(F.collect_list(F.struct("seq", "part", "content")))
    runs = tokens.groupBy("request_id", "_run").agg(
        F.array_join(F.transform(in_run, lambda t: t["content"]), "").alias("_text")
    )
    in_order = F.array_sort(F.collect_list(F.struct("_run", "_text")))
    texts = runs.groupBy("request_id").agg(
        F.array_join(F.transform(in_order, lambda t: t["_text"]), "").alias("content")
    )
    outcome = chunks.groupBy("request_id").agg(
        F.max(F.when(F.col("type") == "cancelled", 1).otherwise(0)).alias("_cancelled"),
        F.max(F.when(F.col("type") == "error", 1).otherwise(0)).alias("_failed"),
    )
    joined = outcome.join(texts, "request_id", "left").withColumn(
        "content", F.coalesce("content", F.lit(""))
    )
    interrupted = F.col("_cancelled") == 1
    stored = interrupted | ((F.col("_failed") == 0) & (F.col("content") != ""))
    return joined.where(stored).select(
        "request_id",
        F.lit("assistant").alias("role"),
        "content",
        F.when(interrupted, F.lit("interrupted")).otherwise(F.lit("completed")).alias("status"),
    )
