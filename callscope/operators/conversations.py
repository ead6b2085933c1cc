"""Conversations and messages: history, context, derived tables and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.text import title
from callscope.operators.keyed import (
    last_n_per_key,
    lookback_window,
    position_in_key,
    with_lookback,
)
from callscope.schemas import DEFAULT_USER, HISTORY_WINDOW, READ_WINDOW


# Messages are read by creation time, then in append order; replies carry their stream's start.
READ_ORDER = ("created_at", "seq")


def history(messages: DataFrame, limit: int = READ_WINDOW) -> DataFrame:
    """The last `limit` messages of every conversation, in the order in which they were created."""
    return last_n_per_key(messages, ["conversation_id"], list(READ_ORDER), limit)


def one_history(messages: DataFrame, conversation_id, limit: int = READ_WINDOW) -> DataFrame:
    """The last messages of one conversation, oldest first."""
    newest = (
        messages.where(F.col("conversation_id") == F.lit(conversation_id))
        .orderBy(*[F.col(c).desc() for c in READ_ORDER])
        .limit(limit)
    )
    return newest.orderBy(*READ_ORDER)


def context_windows(messages: DataFrame, history_size: int = HISTORY_WINDOW) -> DataFrame:
    """Per user turn, the prompt context: up to `history_size` earlier messages and the turn.

    Numbering and look-back move thin rows; texts are fetched once, for the window.
    """
    frame = lookback_window("conversation_id", "position", history_size)
    order = number_messages(messages.select("conversation_id", *READ_ORDER, "role"))
    cut = with_lookback(order, "conversation_id", "position", history_size)
    texts = messages.select("conversation_id", "seq", "content")
    return (
        cut.join(texts, ["conversation_id", "seq"])
        .withColumn("context", F.collect_list(F.struct("role", "content")).over(frame))
        .where(~F.col("_carried") & (F.col("role") == "user"))
        .select("conversation_id", "seq", "context")
    )


def prompt_sources(messages: DataFrame) -> DataFrame:
    """The last user message of every conversation: what a prompt preview is cut from."""
    user = messages.where(F.col("role") == "user")
    return user.groupBy("conversation_id").agg(
        F.max_by("seq", F.struct(*READ_ORDER)).alias("seq"),
        F.max_by("content", F.struct(*READ_ORDER)).alias("content"),
    )


def call_prompts(messages: DataFrame, history_size: int = HISTORY_WINDOW) -> DataFrame:
    """For every reply, the user message that its call ended with: what the preview is cut from.

    A call sees up to `history_size` messages before its reply, in append order.
    """
    cut = with_lookback(
        messages.select("conversation_id", "seq", "role", "content"), "conversation_id", "seq", history_size
    )
    said = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True)
    before = said.over(lookback_window("conversation_id", "seq", history_size))
    return (
        cut.withColumn("prompt", before)
        .where(~F.col("_carried") & (F.col("role") == "assistant"))
        .select("conversation_id", "seq", "prompt")
    )


def number_messages(messages: DataFrame) -> DataFrame:
    """Message order: by creation time, then by append order (`seq`), numbered from 0; rows without a time come first.

    Replies carry their stream's start time, so this is the order a reader sees.
    """
    return position_in_key(messages, "conversation_id", READ_ORDER)


def conversation_table(messages: DataFrame, user_id: Column | None = None) -> DataFrame:
    """Conversations as their messages imply them: title of the opening message, first and last
    activity.  An opening message that is not the user's leaves the title empty."""
    opening = F.struct("created_at", "seq")
    short = F.when(F.col("role") == "user", title(F.col("content")))
    return (
        messages.select("conversation_id", "created_at", "seq", short.alias("_title"))
        .groupBy("conversation_id")
        .agg(
            F.min_by(F.struct("_title"), opening).getField("_title").alias("title"),
            F.min("created_at").alias("created_at"),
            F.max("created_at").alias("updated_at"),
        )
        .select(
            "conversation_id",
            (F.lit(DEFAULT_USER) if user_id is None else user_id).alias("user_id"),
            "title",
            F.lit("active").alias("status"),
            "created_at",
            "updated_at",
        )
    )


def conversation_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Every conversation with its messages."""
    heads = conversations.select("conversation_id", "title", "user_id")
    return messages.join(heads, "conversation_id")


# Table maintenance: each takes tables and returns the new table.


def create_missing(conversations: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Add an empty conversation for every id not there yet."""
    fresh = ids.select("conversation_id").distinct().join(
        conversations, "conversation_id", "left_anti"
    )
    rows = fresh.select(
        "conversation_id",
        F.lit(DEFAULT_USER).alias("user_id"),
        F.lit(None).cast("string").alias("title"),
        F.lit("active").alias("status"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )
    return conversations.unionByName(rows)


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Append; a missing status means completed."""
    if "status" not in new.columns:
        new = new.withColumn("status", F.lit("completed"))
    return messages.unionByName(new, allowMissingColumns=True)


def apply_updates(conversations: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge keyed changes (conversation_id, changed_at, title, status), latest value wins.

    A null means "leave it"; `updated_at` follows title changes and touches, i.e. rows whose
    `touch` is true.  Updates shrink to one row per id before they meet the table.
    """

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("changed_at"))).alias(
            f"_{name}"
        )

    per_id = updates.groupBy("conversation_id").agg(
        latest("title"),
        latest("status"),
        F.max(F.when(F.col("touch"), F.col("changed_at"))).alias("_touched"),
    )
    joined = conversations.join(per_id, "conversation_id", "left")
    return joined.select(
        "conversation_id",
        "user_id",
        F.coalesce("_title", "title").alias("title"),
        F.coalesce("_status", "status").alias("status"),
        "created_at",
        F.greatest("updated_at", "_touched").alias("updated_at"),
    )


def cascade_delete(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Drop the rows of deleted conversations (conversations themselves, or messages)."""
    return table.join(deleted.select("conversation_id"), "conversation_id", "left_anti")


def detach_deleted(logs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Log rows outlive their conversation but lose its id."""
    gone = deleted.select(
        F.col("conversation_id").alias("_gone_id"), F.lit(True).alias("_gone")
    ).distinct()
    named = logs.where(F.col("conversation_id").isNotNull())
    joined = named.join(gone, F.col("conversation_id") == F.col("_gone_id"), "left").withColumn(
        "conversation_id", F.when(F.col("_gone").isNull(), F.col("conversation_id"))
    )
    # Rows without an id have nothing to lose and stay out of the join.
    return joined.select(*logs.columns).union(logs.where(F.col("conversation_id").isNull()))


def with_defaults(table: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add columns older files lack, and fill them where they are null."""
    out = table
    for name, value in defaults.items():
        known = F.coalesce(F.col(name), F.lit(value)) if name in table.columns else F.lit(value)
        out = out.withColumn(name, known)
    return out


def read_evolved(spark, path: str, defaults: dict[str, object]) -> DataFrame:
    """Read Parquet whose older files lack some columns."""
    merged = spark.read.option("mergeSchema", "true").parquet(path)
    return with_defaults(merged, defaults)
