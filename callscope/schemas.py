"""Table and record schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The wire vocabulary.
STATUSES = ("success", "error", "cancelled", "timeout")
CHUNK_TYPES = ("stream_start", "token", "metadata", "done", "error", "cancelled")
PROVIDERS = ("openai", "anthropic", "gemini", "llama")
EVENT_TOPIC = "inference-events"
RATE_LIMITED = "rate_limit_exceeded"
OVER_BUDGET = "token_budget_exceeded"

# Service limits and sizes.
PREVIEW_CHARS = 200
TITLE_CHARS = 28
HISTORY_WINDOW = 20
READ_WINDOW = 200
REQUESTS_PER_MINUTE = 20
MAX_INPUT_TOKENS = 8000
CHARS_PER_TOKEN = 4
STREAM_TTL_SECONDS = 3600
RECENT_BUFFER = 200
DEFAULT_USER = "default-user"


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "usd": T.DecimalType(12, 8),
    # What 32-bit token counts can cost at any rate, and sums of it, always fit these.
    "usd_wide": T.DecimalType(20, 8),
    "usd_sum": T.DecimalType(30, 8),
    "usd_rate": T.DecimalType(9, 3),
    "per_second": T.DecimalType(10, 2),
}


def struct_of(spec: str) -> T.StructType:
    """A schema from "name type, ..." text; usable before any session exists."""
    pairs = [column.split() for column in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# One inference call, typed, after decoding; times are epoch seconds as on the wire.
LOG_EVENT_SCHEMA = struct_of(
    "event_id string, request_id string, conversation_id string, provider string, model string, "
    "started_at double, first_token_at double, completed_at double, "
    "duration_ms int, ttft_ms int, tokens_per_second per_second, "
    "streamed boolean, stream_chunks int, tokens_in int, tokens_out int, "
    "estimated_cost_usd usd, status string, error_code string, error_message string, "
    "prompt_preview string, response_preview string, blocked boolean, block_reason string, "
    "metadata string"
)

# The raw log at rest: timestamps instead of epochs, plus ingest columns.
INFERENCE_LOG_SCHEMA = struct_of(
    "id string, event_id string, request_id string, conversation_id string, "
    "provider string, model string, "
    "started_at timestamp, first_token_at timestamp, completed_at timestamp, "
    "duration_ms int, ttft_ms int, tokens_per_second per_second, "
    "streamed boolean, stream_chunks int, tokens_in int, tokens_out int, "
    "estimated_cost_usd usd_wide, status string, error_code string, error_message string, "
    "prompt_preview string, response_preview string, pii_detected boolean, "
    "blocked boolean, block_reason string, metadata string, created_at timestamp"
)

ROLLUP_KEYS = ("hour_bucket", "provider", "model")
ROLLUP_COUNTERS = (
    "request_count",
    "total_latency_ms",
    "error_count",
    "cancelled_count",
    "blocked_count",
    "total_tokens_in",
    "total_tokens_out",
    "total_cost_usd",
)
ROLLUP_SCHEMA = struct_of(
    "hour_bucket timestamp, provider string, model string, request_count long, "
    "total_latency_ms long, error_count long, cancelled_count long, blocked_count long, "
    "total_tokens_in long, total_tokens_out long, total_cost_usd usd_sum"
)

CONVERSATION_SCHEMA = struct_of(
    "conversation_id string, user_id string, title string, status string, "
    "created_at timestamp, updated_at timestamp"
)
MESSAGE_SCHEMA = struct_of(
    "conversation_id string, seq long, role string, content string, status string, "
    "created_at timestamp"
)

# Raw provider stream lines and their normalised form.
STREAM_LINE_SCHEMA = struct_of(
    "request_id string, provider string, seq long, ts timestamp, line string"
)
CHUNK_SCHEMA = struct_of(
    "request_id string, seq long, part int, ts timestamp, type string, content string, "
    "error string, input_tokens int, output_tokens int"
)

_MODEL = struct_of(
    "id string, name string, context_window long, max_tokens_default int, "
    "supports_streaming boolean"
)
_PROVIDER = struct_of("id string, name string").add("models", T.ArrayType(_MODEL))
REGISTRY_JSON_SCHEMA = T.StructType().add("providers", T.ArrayType(_PROVIDER))
PRICE_SCHEMA = struct_of("model string, input_rate usd_rate, output_rate usd_rate")

# Log columns shown by the recent-logs report.
RECENT_LOG_COLUMNS = tuple(
    f.name for f in INFERENCE_LOG_SCHEMA.fields if f.name not in ("id", "metadata")
)
