"""Hourly rollup by provider and model: build, merge, rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.timing import hour_bucket
from callscope.schemas import ROLLUP_KEYS, ROLLUP_SCHEMA

_TYPES = {f.name: f.dataType for f in ROLLUP_SCHEMA.fields}


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def with_deltas(logs: DataFrame) -> DataFrame:
    """Project each log row to its contribution; rows without completion have none."""
    zero = F.lit(0)
    return logs.where(F.col("completed_at").isNotNull()).select(
        hour_bucket(F.col("completed_at")).alias("hour_bucket"),
        "provider",
        "model",
        F.lit(1).alias("request_count"),
        F.coalesce("duration_ms", zero).alias("total_latency_ms"),
        _flag(F.col("status") == "error").alias("error_count"),
        _flag(F.col("status") == "cancelled").alias("cancelled_count"),
        _flag(F.col("blocked")).alias("blocked_count"),
        F.coalesce("tokens_in", zero).alias("total_tokens_in"),
        F.coalesce("tokens_out", zero).alias("total_tokens_out"),
        F.coalesce("estimated_cost_usd", zero.cast("decimal(20,8)")).alias("total_cost_usd"),
    )


def _sum_counters(df: DataFrame) -> DataFrame:
    counters = [f for f in ROLLUP_SCHEMA.names if f not in ROLLUP_KEYS]
    return df.groupBy(*ROLLUP_KEYS).agg(
        *[F.sum(c).cast(_TYPES[c]).alias(c) for c in counters]
    )


def hourly_rollup(logs: DataFrame) -> DataFrame:
    """Counters per (completion hour, provider, model).

    The sums combine before the shuffle, so a hot key arrives as one row per map task.
    """
    return _sum_counters(with_deltas(logs))


def merge_rollups(stored: DataFrame, *batches: DataFrame) -> DataFrame:
    """Additive merge: union and sum again.  Batches must be new to `stored`."""
    merged = stored
    for batch in batches:
        merged = merged.unionByName(batch)
    return _sum_counters(merged)


def rollup_by_bucket(logs: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Latency per fixed bucket straight from the raw log."""
    done = logs.where(F.col("completed_at").isNotNull() & F.col("duration_ms").isNotNull())
    return (
        done.groupBy(F.window("completed_at", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum("duration_ms").cast("long").alias("total_latency_ms"),
            F.max("duration_ms").alias("max_latency_ms"),
        )
        .select(
            F.col("w.start").alias("bucket"),
            "requests",
            "total_latency_ms",
            "max_latency_ms",
        )
    )
