"""The enrichment chain: an ordered list of DataFrame stages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import pii, timing
from callscope.functions.cost import token_cost
from callscope.schemas import LOG_EVENT_SCHEMA

Stage = Callable[[DataFrame], DataFrame]


def enrich(events: DataFrame, stages: Iterable[Stage]) -> DataFrame:
    """Apply the stages in order."""
    return reduce(lambda df, stage: df.transform(stage), stages, events)


def business_rules(events: DataFrame) -> DataFrame:
    """Slot for rules beyond the schema; passes everything until a caller swaps it."""
    return events


def _is_set(value: Column) -> Column:
    """Whether a metadata value counts as true: empty, zero, false and null do not."""
    text = F.to_json(value)
    return value.isNotNull() & ~text.isin("null", "false", "0", '""', "[]", "{}", "0.0")


def metadata_flag(metadata: Column, name: str) -> Column:
    """Truth of one key of a metadata document held as JSON text."""
    value = F.try_variant_get(F.try_parse_json(metadata), f"$.{name}", "variant")
    has_key = F.contains(metadata, F.lit(f'"{name}"'))
    return F.when(has_key, F.coalesce(_is_set(value), F.lit(False))).otherwise(F.lit(False))


def set_metadata_flag(metadata: Column, name: str) -> Column:
    """The same JSON document with `name` set to true."""
    entries = F.try_variant_get(F.try_parse_json(metadata), "$", "map<string,variant>")
    others = F.map_filter(entries, lambda key, _: key != F.lit(name))
    flag = F.create_map(F.lit(name), F.parse_json(F.lit("true")))
    return F.to_json(F.map_concat(others, flag))


def redact_previews(
    events: DataFrame,
    columns: Sequence[str] = ("prompt_preview", "response_preview"),
    patterns: Sequence[tuple[str, str]] = pii.PII_PATTERNS,
) -> DataFrame:
    """Redact the preview columns, record detection in the metadata and `pii_detected`.

    Metadata that already says so keeps the flag even when nothing matches.
    """
    clean = events.select(
        "*", *[pii.redact(F.col(c), patterns).alias(f"_clean_{c}") for c in columns]
    )
    hit = reduce(
        lambda a, b: a | b,
        [pii.was_redacted(F.col(c), F.col(f"_clean_{c}")) for c in columns],
    )
    flagged = clean.withColumn("_hit", hit).withColumn(
        "metadata",
        F.when(F.col("_hit"), set_metadata_flag(F.col("metadata"), "pii_detected")).otherwise(
            F.col("metadata")
        ),
    )
    out = flagged.withColumn("pii_detected", metadata_flag(F.col("metadata"), "pii_detected"))
    for c in columns:
        out = out.withColumn(c, F.col(f"_clean_{c}"))
    return out.drop("_hit", *[f"_clean_{c}" for c in columns])


def pii_stage(patterns: Sequence[tuple[str, str]]) -> Stage:
    """Redaction with the caller's own patterns."""
    return lambda events: redact_previews(events, patterns=patterns)


def price_stage(prices: DataFrame) -> Stage:
    """Pricing from a price table."""
    return lambda events: price_events(events, prices)


def price_events(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Fill `estimated_cost_usd` from the price table.

    A priced model always gets a cost, 0 without tokens; an unpriced one keeps what came in.
    The price table is a config-sized lookup; Spark broadcasts it by its measured size.
    """
    rates = prices.select("model", "input_rate", "output_rate")
    cost = token_cost(
        F.col("tokens_in"), F.col("tokens_out"), F.col("input_rate"), F.col("output_rate")
    )
    incoming = (
        F.col("estimated_cost_usd")
        if "estimated_cost_usd" in events.columns
        else F.lit(None)
    ).cast("decimal(20,8)")
    priced = events.join(rates, "model", "left").withColumn(
        "estimated_cost_usd", F.when(F.col("input_rate").isNotNull(), cost).otherwise(incoming)
    )
    return priced.drop("input_rate", "output_rate")


def check_costs(checked: DataFrame, prices: DataFrame) -> DataFrame:
    """Reject events whose price exceeds what the log's cost column may hold (wire type)."""
    wide = price_events(checked.select("*", F.col("estimated_cost_usd").alias("_given")), prices)
    limit = LOG_EVENT_SCHEMA["estimated_cost_usd"].dataType
    misfit = F.col("estimated_cost_usd").isNotNull() & F.col("estimated_cost_usd").try_cast(limit).isNull()
    reason = F.when(misfit, F.lit("estimated_cost_usd: out of range"))
    return (
        wide.withColumn("reject_reason", F.coalesce("reject_reason", reason))
        .withColumn("estimated_cost_usd", F.col("_given"))
        .select(*checked.columns)
    )


def derive_timings(events: DataFrame) -> DataFrame:
    """Fill duration, time to first token and output rate from the epoch columns."""
    return (
        events.withColumn(
            "duration_ms",
            F.coalesce(
                timing.duration_ms(F.col("started_at"), F.col("completed_at")),
                F.col("duration_ms"),
            ),
        )
        .withColumn(
            "ttft_ms",
            F.coalesce(
                timing.ttft_ms(F.col("started_at"), F.col("first_token_at")), F.col("ttft_ms")
            ),
        )
        .withColumn(
            "tokens_per_second",
            F.coalesce(
                timing.tokens_per_second(F.col("tokens_out"), F.col("duration_ms")),
                F.col("tokens_per_second"),
            ),
        )
    )
