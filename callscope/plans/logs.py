"""Row reports: recent logs, blocked events, conversation lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.timing import age_label
from callscope.schemas import DEFAULT_USER, RECENT_BUFFER, RECENT_LOG_COLUMNS

# Bounds of the recent-logs report.
DEFAULT_LIMIT, MIN_LIMIT, MAX_LIMIT = 50, 1, 500
_ISO_SECONDS, _ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ssxxx", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def filter_logs(
    logs: DataFrame, status: str | None = None, provider: str | None = None, conversation_id=None
) -> DataFrame:
    """Conjunction of the filters that were given."""
    given = {"status": status, "provider": provider, "conversation_id": conversation_id}
    tests = [F.col(name) == F.lit(value) for name, value in given.items() if value]
    return logs.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def recent_logs(logs: DataFrame, limit: int = DEFAULT_LIMIT, **filters) -> DataFrame:
    """The newest log rows by arrival; each task keeps only its own top rows."""
    if not MIN_LIMIT <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between {MIN_LIMIT} and {MAX_LIMIT}, got {limit}")
    columns = [c for c in RECENT_LOG_COLUMNS if c in logs.columns]
    return (
        filter_logs(logs, **filters)
        .select(*columns)
        .orderBy(F.col("created_at").desc(), "event_id")
        .limit(limit)
    )


def serialise_logs(rows: DataFrame) -> DataFrame:
    """Log rows as an API shows them: ISO times, text ids, decimals as doubles."""

    def shown(field):
        kind = field.dataType.typeName()
        if kind == "timestamp":
            whole = F.unix_micros(field.name) % 1_000_000 == 0
            shown_time = F.when(whole, F.date_format(field.name, _ISO_SECONDS)).otherwise(
                F.date_format(field.name, _ISO_MICROS)
            )
            return shown_time.alias(field.name)
        if kind == "decimal":
            return F.col(field.name).cast("double").alias(field.name)
        if field.name.endswith("_id"):
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return rows.select(*[shown(f) for f in rows.schema.fields])


def blocked_events(logs: DataFrame) -> DataFrame:
    """Blocked calls, newest first."""
    return logs.where(F.col("blocked")).orderBy(F.col("created_at").desc(), "event_id")


def recent_buffer(events: DataFrame, size: int = RECENT_BUFFER) -> DataFrame:
    """The last emitted events, newest first."""
    return events.orderBy(F.col("emitted_at").desc(), "event_id").limit(size)


def list_conversations(
    conversations: DataFrame, user_id: str = DEFAULT_USER, limit: int = 50, as_of=None
) -> DataFrame:
    """A user's conversations, last active first, with a readable age."""
    return (
        conversations.where(F.col("user_id") == F.lit(user_id))
        .orderBy(F.col("updated_at").desc(), "conversation_id")
        .limit(limit)
        .withColumn("age", age_label(F.col("updated_at"), as_of))
    )
