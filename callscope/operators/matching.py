"""Joins of the control and ingest paths: stored ids, live streams, cancels, users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.identity import canonical_uuid
from callscope.functions.timing import as_timestamp
from callscope.schemas import STREAM_TTL_SECONDS


def first_arrivals(events: DataFrame, arrival: str) -> DataFrame:
    """One row per event id: the copy that arrived first.

    `row_number = 1` lets every task drop all but its own first copy before the shuffle, so an
    id with very many copies moves one row per task.
    """
    in_order = Window.partitionBy("event_id").orderBy(arrival)
    return events.withColumn("_rn", F.row_number().over(in_order)).where(F.col("_rn") == 1).drop("_rn")


def unseen(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch rows whose event id the log does not hold.

    The log is first cut down to the ids of the batch, so a small batch is sent to the log's
    files instead of the whole id column being shuffled per batch.
    """
    ids = batch.select("event_id")
    seen = stored.select("event_id").join(ids, "event_id", "left_semi")
    return batch.join(seen, "event_id", "left_anti")


def active_streams(
    starts: DataFrame, ends: DataFrame, as_of=None, ttl_seconds: int = STREAM_TTL_SECONDS
) -> DataFrame:
    """Streams started within the time to live and not ended by `as_of`."""
    now = as_timestamp(as_of)
    oldest = now - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))
    live = starts.where((F.col("started_at") > oldest) & (F.col("started_at") <= now))
    # A live stream's end is no older than its start, so older ends need not be read.
    ended = ends.where((F.col("ended_at") > oldest) & (F.col("ended_at") <= now)).select("request_id")
    return live.join(ended, "request_id", "left_anti")


def parse_cancels(messages: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(valid cancels with `request_id`, malformed ones)."""
    parsed = messages.withColumn("request_id", canonical_uuid(F.col(payload)))
    good = parsed.where(F.col("request_id").isNotNull())
    return good, parsed.where(F.col("request_id").isNull()).drop("request_id")


def match_cancels(cancels: DataFrame, streams: DataFrame) -> DataFrame:
    """Cancels that reach their stream while it is open.

    Only the first one in time takes effect; the stream is gone afterwards.
    """
    open_now = F.col("cancel_ts").between(F.col("started_at"), F.col("ended_at"))
    hits = cancels.join(streams, "request_id").where(open_now)
    return hits.groupBy("request_id").agg(F.min("cancel_ts").alias("cancel_ts"))


def usage_by_user(logs: DataFrame, conversations: DataFrame) -> DataFrame:
    """Requests, tokens and cost per user.

    Logs are summed per conversation before the join, so neither a hot conversation nor a hot
    user moves more than one row per map task.
    """
    per_conversation = (
        logs.where(F.col("conversation_id").isNotNull())
        .groupBy("conversation_id")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
            F.sum("estimated_cost_usd").alias("cost"),
        )
    )
    owners = conversations.select("conversation_id", "user_id")
    return (
        per_conversation.join(owners, "conversation_id")
        .groupBy("user_id")
        .agg(
            F.sum("requests").alias("requests"),
            F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
            F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
            F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)).alias("total_cost_usd"),
        )
    )
