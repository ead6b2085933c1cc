"""Cancel requests met with stream lifecycles, both as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.streaming.state import LATENESS_SECONDS, first_cancels


def match_cancels_live(
    cancels: DataFrame, streams: DataFrame, lateness_seconds: int = LATENESS_SECONDS
) -> DataFrame:
    """request_id and cancel_ts of the first cancel in each stream's open time.

    The rule of the batch form `match_cancels`: however long the stream is open, its first cancel takes
    effect and the stream is gone afterwards.  `streams` has request_id, started_at, ended_at.
    """
    extra = ["arrived_at"] if "arrived_at" in cancels.columns else []
    none = F.lit(None).cast("long")
    asked = cancels.select(
        "request_id", F.lit("cancel").alias("kind"), none.alias("started_us"), none.alias("ended_us"), F.unix_micros("cancel_ts").alias("at_us"), *extra
    )
    spans = streams.select(
        "request_id", F.lit("span").alias("kind"), F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), none.alias("at_us"), *extra
    )
    found = first_cancels(asked.unionByName(spans), lateness_seconds)
    return found.select("request_id", F.timestamp_micros("cancel_us").alias("cancel_ts"))
