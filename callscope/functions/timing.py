"""Epochs, derived latencies, hour buckets, window strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted window strings and their units in seconds.
WINDOW_PATTERN = r"^(\d+)([hmd])$"
WINDOW_UNIT_SECONDS = {"h": 3600, "m": 60, "d": 86400}


def epoch_to_timestamp(epoch: Column) -> Column:
    """Epoch seconds to timestamp, rounded (not cut) to the microsecond; null stays null."""
    return F.timestamp_micros(F.rint(epoch * F.lit(1e6)).try_cast("bigint"))


def timestamp_to_epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def _elapsed_ms(start: Column, end: Column) -> Column:
    usable = (start != 0) & (end != 0)
    return F.when(usable, ((end - start) * 1000).try_cast("int"))


def duration_ms(started_at: Column, completed_at: Column) -> Column:
    """Whole milliseconds from start to completion, cut towards zero."""
    return _elapsed_ms(started_at, completed_at)


def ttft_ms(started_at: Column, first_token_at: Column) -> Column:
    """Whole milliseconds from start to the first token."""
    return _elapsed_ms(started_at, first_token_at)


def tokens_per_second(tokens_out: Column, duration: Column) -> Column:
    """Output rate at two places; null where either side is zero or missing."""
    rate = F.bround(tokens_out / duration * 1000, 2)
    return F.when((duration > 0) & (tokens_out != 0), rate.try_cast("decimal(10,2)"))


def hour_bucket(completed_at: Column) -> Column:
    return F.date_trunc("HOUR", completed_at)


def window_seconds(window: str) -> int:
    """`15m`, `24h`, `7d` as seconds; anything else is a ValueError.  `m` means minutes."""
    match = re.match(WINDOW_PATTERN, window)
    if not match:
        raise ValueError(f"bad window {window!r}: write it like 15m, 24h or 7d")
    return int(match.group(1)) * WINDOW_UNIT_SECONDS[match.group(2)]


def as_timestamp(as_of) -> Column:
    """`as_of` arguments: None is now, text and datetimes are literals, columns pass."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def window_start(window: str, as_of=None) -> Column:
    seconds = window_seconds(window)
    return as_timestamp(as_of) - F.make_dt_interval(secs=F.lit(float(seconds)))


def in_window(ts: Column, window: str, as_of=None) -> Column:
    """Strictly after the window start.  There is no upper bound."""
    return ts > window_start(window, as_of)


def age_label(ts: Column, as_of=None) -> Column:
    """`just now`, `5m ago`, `3h ago`, and the plain date from one day on."""
    minutes = F.floor((F.unix_micros(as_timestamp(as_of)) - F.unix_micros(ts)) / F.lit(60_000_000))
    hours = F.floor(minutes / 60)
    return (
        F.when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
