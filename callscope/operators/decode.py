"""JSON payloads to typed events, with a reason for every rejected one.

Each field is parsed to a variant first and typed afterwards, because the wire contract is
lenient about some spellings ("12" is an int) and strict about others (12 is not a string, an
explicit null is not an absent field); a parse straight to the final types cannot tell these
apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import timing
from callscope.functions.identity import canonical_uuid, payload_uuid
from callscope.operators.keyed import isolated_join
from callscope.schemas import INFERENCE_LOG_SCHEMA, LOG_EVENT_SCHEMA, STATUSES
from callscope.session import scratch_dir

# Spellings accepted for a boolean.
_TRUE_WORDS = ("1", "true", "t", "yes", "y", "on")
_FALSE_WORDS = ("0", "false", "f", "no", "n", "off")

_FLOAT_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INTEGER_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"
# Epochs of years 1 and 9999, the range a timestamp may have.
_EPOCH_MIN, _EPOCH_MAX = -62135596800.0, 253402300799.0


@dataclass(frozen=True)
class Field:
    """How one field travels: its kind, whether it may be null, and what absence means."""

    name: str
    kind: str
    nullable: bool = False
    required: bool = False
    default: object = None


WIRE_FIELDS = (
    Field("event_id", "uuid"),
    Field("request_id", "uuid", required=True),
    Field("conversation_id", "uuid", nullable=True),
    Field("provider", "string", required=True),
    Field("model", "string", required=True),
    Field("started_at", "float", required=True),
    Field("first_token_at", "float", nullable=True),
    Field("completed_at", "float", nullable=True),
    Field("duration_ms", "int", nullable=True),
    Field("ttft_ms", "int", nullable=True),
    Field("tokens_per_second", "float", nullable=True),
    Field("streamed", "bool", default=False),
    Field("stream_chunks", "int", default=0),
    Field("tokens_in", "int", nullable=True),
    Field("tokens_out", "int", nullable=True),
    Field("estimated_cost_usd", "float", nullable=True),
    Field("status", "status", default="success"),
    Field("error_code", "string", nullable=True),
    Field("error_message", "string", nullable=True),
    Field("prompt_preview", "string", default=""),
    Field("response_preview", "string", default=""),
    Field("blocked", "bool", default=False),
    Field("block_reason", "string", nullable=True),
    Field("metadata", "map", default="{}"),
)


def _kind(name: str) -> Column:
    return F.col(f"_kind_{name}")


def _read(f: Field) -> Column:
    """The field's value in its wire kind; null where the value does not fit."""
    kind, raw, path = _kind(f.name), F.col(f"_raw_{f.name}"), "$"
    text = F.when(kind == "STRING", F.try_variant_get(raw, path, "string"))
    number = F.try_variant_get(raw, path, "double")
    if f.kind == "string":
        return text
    if f.kind == "status":
        return F.when(text.isin(*STATUSES), text)
    if f.kind == "uuid":
        return canonical_uuid(text)
    if f.kind == "float":
        return F.when((kind != "STRING") | F.rlike(text, F.lit(_FLOAT_TEXT)), number)
    if f.kind == "int":
        readable = (kind != "STRING") | F.rlike(text, F.lit(_INTEGER_TEXT))
        whole = readable & (number == F.rint(number))
        # Exact up to 2^53, far beyond the 32 bits a count may have.
        return F.when(whole, number.try_cast("bigint"))
    if f.kind == "bool":
        word = F.lower(text)
        return (
            F.when(kind == "BOOLEAN", F.try_variant_get(raw, path, "boolean"))
            .when(word.isin(*_TRUE_WORDS), F.lit(True))
            .when(word.isin(*_FALSE_WORDS), F.lit(False))
            .when(kind != "STRING", F.when(number == 1, True).when(number == 0, False))
        )
    if f.kind == "map":
        return F.when(F.startswith(kind, F.lit("OBJECT")), F.to_json(raw))
    raise ValueError(f.kind)


def _problem(f: Field) -> Column:
    """Text naming what is wrong with the field, null when nothing is."""
    kind = _kind(f.name)
    absent = kind.isNull()
    is_null = kind == "VOID"
    checks = F.when(absent, F.lit(f"{f.name}: missing") if f.required else F.lit(None))
    if f.nullable:
        checks = checks.when(is_null, F.lit(None))
    return checks.when(F.col(f.name).isNull(), F.lit(f"{f.name}: invalid"))


def _filled(f: Field) -> Column:
    if f.name == "event_id":
        return F.when(_kind("event_id").isNull(), payload_uuid(F.col("payload"))).otherwise(
            F.col("event_id")
        )
    if f.default is None:
        return F.col(f.name)
    return F.when(_kind(f.name).isNull(), F.lit(f.default)).otherwise(F.col(f.name))


def decode_events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Parse, type, default and check each payload.

    Every input row comes back once: wire-typed fields plus `payload` and `reject_reason`, which
    is null for a good event.  Fields the contract does not know are ignored; other columns of
    the input (offsets, arrival order) are kept.
    """
    extra = [c for c in raw.columns if c != payload]
    # The typed row leaves through `inline`, so a filter on the reason is applied to its value.
    # Pushed below instead, it would repeat the whole decoding inside its condition.
    shape = ", ".join(f"{f.name} variant" for f in WIRE_FIELDS) + ", _broken string"
    parsed = raw.select(
        *extra,
        F.col(payload).alias("payload"),
        F.from_json(payload, shape, {"columnNameOfCorruptRecord": "_broken"}).alias("_doc"),
    )
    opened = parsed.select(
        *extra,
        "payload",
        (F.col("_doc").isNull() | F.col("_doc._broken").isNotNull()).alias("_broken"),
        *[F.col(f"_doc.{f.name}").alias(f"_raw_{f.name}") for f in WIRE_FIELDS],
    )
    named = opened.select(
        "*", *[F.schema_of_variant(f"_raw_{f.name}").alias(f"_kind_{f.name}") for f in WIRE_FIELDS]
    )
    typed = named.select(
        *extra,
        "payload",
        "_broken",
        *[_kind(f.name) for f in WIRE_FIELDS],
        *[_read(f).alias(f.name) for f in WIRE_FIELDS],
    )
    reason = F.when(F.col("_broken"), F.lit("payload: not JSON")).otherwise(
        F.coalesce(*[_problem(f) for f in WIRE_FIELDS])
    )
    row = F.struct(
        reason.alias("reject_reason"), *[_filled(f).alias(f.name) for f in WIRE_FIELDS]
    )
    return typed.select(*extra, "payload", F.inline(F.array(row)))


def fit_to_log(decoded: DataFrame) -> DataFrame:
    """Narrow wire types to the log's column types; what does not fit is rejected.

    ints become 32-bit, money and rates become decimals, epochs must be representable times.
    """
    narrow = {
        f.name: LOG_EVENT_SCHEMA[f.name].dataType
        for f in WIRE_FIELDS
        if f.kind in ("int", "float") and LOG_EVENT_SCHEMA[f.name].dataType.typeName() != "double"
    }
    epochs = ("started_at", "first_token_at", "completed_at")
    values = {}
    for name, dtype in narrow.items():
        source = F.col(name)
        if dtype.typeName() == "decimal":
            source = F.bround(source.try_cast("decimal(38,12)"), dtype.scale)
        values[name] = source.try_cast(dtype)
    for name in epochs:
        values[name] = F.when(F.col(name).between(_EPOCH_MIN, _EPOCH_MAX), F.col(name))

    misfit = F.coalesce(
        *[
            F.when(F.col(name).isNotNull() & value.isNull(), F.lit(f"{name}: out of range"))
            for name, value in values.items()
        ]
    )
    keep = [c for c in decoded.columns if c not in values and c != "reject_reason"]
    return decoded.select(
        *keep,
        F.coalesce("reject_reason", misfit).alias("reject_reason"),
        *[v.alias(n) for n, v in values.items()],
    )


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected).  Rejects keep the raw payload for the dead-letter table."""
    accepted = checked.where(F.col("reject_reason").isNull()).drop("reject_reason", "payload")
    tracked = [c for c in checked.columns if c not in LOG_EVENT_SCHEMA.names]
    rejected = checked.where(F.col("reject_reason").isNotNull()).select(*tracked)
    return accepted, rejected


def stored_once(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written to a scratch folder and read from there, so that several passes over them don't decode again."""
    path = scratch_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def check_conversations(checked: DataFrame, conversations: DataFrame) -> DataFrame:
    """Reject events whose conversation does not exist; events without one pass.

    Goes over `checked` several times, so decoded rows should be cached or stored (`stored_once`).

    The conversations are first cut down to the ids that the events name, once each, so what
    meets the events grows with the batch and not with the table.  Ids with many events are
    looked up apart from the others, and events without an id are spread.
    """
    ids = checked.select("conversation_id").where(F.col("conversation_id").isNotNull()).distinct()
    known = conversations.select("conversation_id").join(ids, "conversation_id", "left_semi").distinct().withColumn("_known", F.lit(True))
    joined = isolated_join(checked, known, "conversation_id", checked.columns[:2])
    orphan = F.when(F.col("conversation_id").isNotNull() & F.col("_known").isNull(), F.lit("conversation_id: unknown"))
    return joined.withColumn("reject_reason", F.coalesce("reject_reason", orphan)).select(*checked.columns)


def readmit(letters: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dead letters (payload, reject_reason, ...) as (payloads to ingest again, letters that stay).

    An event can arrive before its conversation is stored; such letters pass once it is there.
    What fails for any other reason stays.  Letters are decoded once and stored in between.
    """
    waiting = F.col("reject_reason") == "conversation_id: unknown"
    extra = [c for c in letters.columns if c not in ("payload", "reject_reason")]
    again = fit_to_log(decode_events(letters.where(waiting).select(*extra, "payload")))
    names = [f"_c{n}" for n in range(len(extra))]
    again = again.select(*[F.col(c).alias(n) for c, n in zip(extra, names, strict=True)], "payload", "conversation_id", "reject_reason")
    checked = check_conversations(stored_once(again, "readmitted"), conversations)
    checked = checked.select(*[F.col(n).alias(c) for n, c in zip(names, extra, strict=True)], "payload", "reject_reason")
    passed = checked.where(F.col("reject_reason").isNull()).select(*extra, "payload")
    failed = checked.where(F.col("reject_reason").isNotNull()).select(*extra, "payload", "reject_reason")
    return passed, letters.where(~waiting).select(*extra, "payload", "reject_reason").union(failed)


def to_log_rows(accepted: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Enriched events in the raw log's shape: epochs as timestamps, a row id, ingest time."""
    stamped = accepted.withColumn(
        "created_at", F.current_timestamp() if created_at is None else created_at
    ).withColumn("id", payload_uuid(F.col("event_id")))
    for name in ("started_at", "first_token_at", "completed_at"):
        stamped = stamped.withColumn(name, timing.epoch_to_timestamp(F.col(name)))
    return stamped.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in INFERENCE_LOG_SCHEMA.fields]
    )


def to_wire(events: DataFrame) -> DataFrame:
    """Events as keyed JSON records for a topic: key is the event id, value the document."""
    names = [c for c in LOG_EVENT_SCHEMA.names if c in events.columns]
    fields = [
        F.try_parse_json("metadata").alias("metadata") if c == "metadata" else F.col(c)
        for c in names
    ]
    document = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return events.select(
        F.col("event_id").cast("string").alias("key"), document.alias("value")
    )
