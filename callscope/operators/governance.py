"""Admission checks as table jobs: rate limit, token budget, and the events they produce."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.identity import payload_uuid
from callscope.functions.text import estimated_tokens, preview
from callscope.operators.conversations import number_messages
from callscope.operators.enrich import derive_timings
from callscope.operators.keyed import SPREAD, lookback_window, nth_in_order, spread_join, with_lookback
from callscope.schemas import (
    HISTORY_WINDOW,
    LOG_EVENT_SCHEMA,
    MAX_INPUT_TOKENS,
    OVER_BUDGET,
    RATE_LIMITED,
    REQUESTS_PER_MINUTE,
)


def rate_bucket(ts: Column, seconds: int = 60) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("long")


def flag_rate_limited(
    requests: DataFrame,
    limit: int = REQUESTS_PER_MINUTE,
    bucket_seconds: int = 60,
    key: str = "conversation_id",
    order: tuple[str, str] = ("started_at", "request_id"),
) -> DataFrame:
    """Add `over_rate`: true from request number limit + 1 on in a (key, bucket).

    Rejected requests count too, as the counter moves before any check.  The limit-th request of
    a bucket is the cutoff, so a busy bucket is compared with one row instead of being sorted, in many places.
    """
    bucketed = requests.withColumn("rate_bucket", rate_bucket(F.col(order[0]), bucket_seconds))
    cutoffs = nth_in_order(bucketed, [key, "rate_bucket"], order, limit, name="_cutoff")
    marked = spread_join(bucketed, cutoffs, [key, "rate_bucket"], order, max(2, min(SPREAD, limit)))
    late = F.struct(*order) > F.col("_cutoff")
    return marked.withColumn("over_rate", F.coalesce(late, F.lit(False))).drop("_cutoff")


def flag_token_bucket(
    requests: DataFrame, capacity: int, per_minute: float, key: str = "conversation_id", order: tuple[str, str] = ("started_at", "request_id")
) -> DataFrame:
    """Add `over_rate` by a bucket per key that holds `capacity` tokens and refills by `per_minute` steadily.

    Each decision depends on the one before, but not across a pause that refills the bucket for certain.  Time is
    cut into slots as long as a refill; a slot without requests is such a pause.  The runs of used slots are
    found on distinct slots, and are decided independently.  A run of no more requests than tokens is admitted
    as it is; others are read in order of time, one level being all that is kept of a run.
    Requests without a time are not decided: their flag is null.
    """
    rate = per_minute / 60.0
    slot_ms = int(capacity / rate * 1000) + 1
    timed = requests.withColumn("_at", F.unix_millis(order[0])).withColumn("_slot", F.floor(F.col("_at") / F.lit(slot_ms)))
    known, unknown = timed.where(F.col("_at").isNotNull()), timed.where(F.col("_at").isNull())
    used = known.groupBy(F.col(key).alias("_key"), F.col("_slot").alias("_used")).agg(F.count(F.lit(1)).alias("_n"))
    by_slot = Window.partitionBy("_key").orderBy("_used")
    first = F.coalesce(F.col("_used") - F.lag("_used").over(by_slot) > 1, F.lit(True))
    runs = used.withColumn("_first", first).withColumn("_run", F.sum(F.col("_first").cast("long")).over(by_slot))
    sizes = runs.withColumn("_n", F.sum("_n").over(Window.partitionBy("_key", "_run"))).select("_key", "_used", "_run", "_n")
    placed = known.join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_used"))).drop("_key", "_used", "_slot")
    busy = placed.where(F.col("_n") > capacity).repartition(key, "_run").sortWithinPartitions(key, "_run", "_at", order[1])
    schema = T.StructType([*requests.schema.fields, T.StructField("over_rate", T.BooleanType())])
    decided = busy.select(*requests.columns, "_at", "_run").mapInPandas(_decide_in_order(key, float(capacity), rate), schema)
    flag = lambda rows, value: rows.select(*requests.columns, F.lit(value).cast("boolean").alias("over_rate"))
    return decided.union(flag(placed.where(F.col("_n") <= capacity), False)).union(flag(unknown, None))


def _decide_in_order(key: str, capacity: float, rate: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tokens, last = None, capacity, 0
        for batch in batches:
            over = []
            keys = batch[key].astype(object).where(batch[key].notna(), None)
            for own, at in zip(zip(keys, batch["_run"], strict=True), batch["_at"], strict=True):
                if own != now:
                    now, tokens, last = own, capacity, at
                tokens = min(capacity, tokens + (at - last) / 1000 * rate)
                last = at
                over.append(tokens < 1.0)
                tokens -= 0.0 if over[-1] else 1.0
            yield batch.drop(columns=["_at", "_run"]).assign(over_rate=over)

    return run


def flag_over_budget(
    messages: DataFrame,
    max_tokens: int = MAX_INPUT_TOKENS,
    history: int = HISTORY_WINDOW,
    estimate: Callable[[Column], Column] = estimated_tokens,
) -> DataFrame:
    """User turns with `context_chars`, `context_tokens` and `over_budget`.

    The context is up to `history` earlier messages, by creation time where it is known, plus the
    turn itself.  Only lengths are moved, not the texts.  `estimate` turns a character total into tokens.
    """
    thin = messages.select(
        "conversation_id",
        "seq",
        "role",
        F.col("created_at") if "created_at" in messages.columns else F.lit(None).cast("timestamp").alias("created_at"),
        F.length(F.coalesce("content", F.lit(""))).alias("_chars"),
    )
    frame = lookback_window("conversation_id", "position", history)
    return (
        with_lookback(number_messages(thin), "conversation_id", "position", history)
        .withColumn("context_chars", F.sum("_chars").over(frame))
        .where(~F.col("_carried") & (F.col("role") == "user"))
        .withColumn("context_tokens", estimate(F.col("context_chars")))
        .withColumn("over_budget", F.col("context_tokens") > max_tokens)
        .select("conversation_id", "seq", "context_chars", "context_tokens", "over_budget")
    )


def decide(over_rate: Column, over_budget: Column) -> Column:
    """The block reason; the rate check comes first."""
    return F.when(over_rate, F.lit(RATE_LIMITED)).when(over_budget, F.lit(OVER_BUDGET))


def govern(
    requests: DataFrame,
    messages: DataFrame,
    limit: int = REQUESTS_PER_MINUTE,
    bucket_seconds: int = 60,
    max_tokens: int = MAX_INPUT_TOKENS,
    history: int = HISTORY_WINDOW,
    estimate: Callable[[Column], Column] = estimated_tokens,
) -> DataFrame:
    """Requests (one per user turn: conversation_id, seq, request_id, started_at, ...) with
    `block_reason`, null where admitted."""
    rated = flag_rate_limited(requests, limit, bucket_seconds)
    budget = flag_over_budget(messages, max_tokens, history, estimate)
    joined = rated.join(budget, ["conversation_id", "seq"], "left")
    return joined.withColumn(
        "block_reason",
        decide(F.col("over_rate"), F.coalesce("over_budget", F.lit(False))),
    )


def block_message(
    limit: int = REQUESTS_PER_MINUTE, max_tokens: int = MAX_INPUT_TOKENS
) -> Column:
    """The message shown to a blocked caller.  Fixed wording."""
    rate_text = F.lit(f"Rate limit exceeded: max {limit} requests/minute per conversation.")
    budget_text = F.concat(
        F.lit("Input too large: estimated "),
        F.col("context_tokens").cast("string"),
        F.lit(
            f" tokens exceeds the {max_tokens}-token limit. "
            "Shorten your message or start a new conversation."
        ),
    )
    return F.when(F.col("block_reason") == RATE_LIMITED, rate_text).otherwise(budget_text)


def blocked_events(
    governed: DataFrame, limit: int = REQUESTS_PER_MINUTE, max_tokens: int = MAX_INPUT_TOKENS
) -> DataFrame:
    """One log event per blocked request: an error that ends when it starts, without tokens.

    Needs provider, model and content next to the decision.
    """
    now = F.unix_micros("started_at") / F.lit(1e6)
    given = {
        "event_id": payload_uuid(F.concat(F.lit("blocked:"), F.col("request_id"))),
        "request_id": F.col("request_id"),
        "conversation_id": F.col("conversation_id"),
        "provider": F.col("provider"),
        "model": F.col("model"),
        "started_at": now,
        "completed_at": now,
        "streamed": F.lit(False),
        "stream_chunks": F.lit(0),
        "status": F.lit("error"),
        "error_message": block_message(limit, max_tokens),
        "prompt_preview": preview(F.col("content")),
        "response_preview": F.lit(""),
        "blocked": F.lit(True),
        "block_reason": F.col("block_reason"),
        "metadata": F.lit("{}"),
    }
    blocked = governed.where(F.col("block_reason").isNotNull()).select(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOG_EVENT_SCHEMA.fields
        ]
    )
    return derive_timings(blocked)


def merge_event_streams(provider_events: DataFrame, *others: DataFrame) -> DataFrame:
    """Streamed calls, blocked calls and calls answered whole as one event stream."""
    merged = provider_events
    for other in others:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged
