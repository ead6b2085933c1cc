"""The registered queries in plain SQL (DuckDB dialect), over the same tables."""

from __future__ import annotations

from callscope.catalog.views import AS_OF

# Registry models in file order and prices in thousandths of a USD per million.
_REGISTRY = """
registry(pos, provider, model, context_window) AS (VALUES
  (0, 'anthropic', 'claude-haiku-4-5-20251001', 200000),
  (1, 'anthropic', 'claude-sonnet-4-6', 200000),
  (2, 'anthropic', 'claude-opus-4-7', 200000),
  (3, 'openai', 'gpt-4o', 128000),
  (4, 'openai', 'gpt-4o-mini', 128000),
  (5, 'openai', 'gpt-4-turbo', 128000),
  (6, 'gemini', 'gemini-flash-latest', 1048576),
  (7, 'gemini', 'gemini-2.5-flash-preview-05-20', 1048576),
  (8, 'gemini', 'gemini-2.0-flash', 1048576),
  (9, 'llama', 'llama3.1-70b', 128000),
  (10, 'llama', 'llama3.1-8b', 128000)),
prices(model, in_milli, out_milli) AS (VALUES
  ('claude-haiku-4-5-20251001', 800, 4000),
  ('claude-3-5-haiku-20241022', 800, 4000),
  ('claude-sonnet-4-6', 3000, 15000),
  ('claude-opus-4-7', 15000, 75000),
  ('gpt-4o-mini', 150, 600),
  ('gpt-4o', 2500, 10000),
  ('gpt-4-turbo', 10000, 30000),
  ('gemini-flash-latest', 75, 300),
  ('gemini-2.0-flash', 75, 300),
  ('gemini-2.5-flash-preview-05-20', 150, 600))"""

_BASE = f"""{_REGISTRY},
raw AS (
  SELECT event_id, user_id, ts AS started_at, event_type, event_id % 11 AS pos,
    CAST(round(value * 100) AS INTEGER) AS raw_ms,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    event_type = 'error' AS failed, event_type = 'signup' AS gave_up,
    event_type = 'error' AND event_id % 2 = 0 AS blocked
  FROM events),
calls0 AS (
  SELECT event_id, user_id, provider, model, started_at, blocked,
    CASE WHEN user_id % 10 <> 0 THEN user_id END AS conversation_id,
    CASE WHEN failed THEN 'error' WHEN gave_up THEN 'cancelled' ELSE 'success' END AS status,
    CASE WHEN blocked THEN CASE WHEN event_id % 4 = 0 THEN 'rate_limit_exceeded'
      ELSE 'token_budget_exceeded' END END AS block_reason,
    CASE WHEN blocked THEN 0 ELSE raw_ms END AS duration_ms,
    CASE WHEN NOT failed THEN raw_ms // 4 END AS ttft_ms,
    CASE WHEN NOT failed THEN 50 + 37 * k END AS tokens_in,
    CASE WHEN NOT failed AND NOT gave_up THEN raw_ms // 20 END AS tokens_out
  FROM raw JOIN registry USING (pos)),
calls1 AS (
  SELECT *, started_at + duration_ms * INTERVAL 1 MILLISECOND AS completed_at FROM calls0),
calls AS (
  SELECT *, completed_at + (event_id % 7200) * INTERVAL 1 SECOND AS created_at FROM calls1),
nano AS (
  SELECT c.*, p.model IS NOT NULL AS priced,
    coalesce(tokens_in, 0)::BIGINT * in_milli + coalesce(tokens_out, 0)::BIGINT * out_milli AS nano
  FROM calls c LEFT JOIN prices p USING (model)),
logs AS (
  SELECT * EXCLUDE (nano, priced),
    CASE WHEN duration_ms > 0 AND tokens_out <> 0
      THEN CAST(round_even(tokens_out / duration_ms * 1000, 2) AS DECIMAL(10,2))
    END AS tokens_per_second,
    CASE WHEN priced THEN CAST((nano // 10 + CASE
        WHEN nano % 10 > 5 OR (nano % 10 = 5 AND (nano // 10) % 2 = 1) THEN 1 ELSE 0 END
      ) * 0.00000001::DECIMAL(9,8) AS DECIMAL(20,8)) END AS estimated_cost_usd
  FROM nano),
rollup AS (
  SELECT date_trunc('hour', completed_at) AS hour_bucket, provider, model,
    count(*) AS request_count,
    CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS total_latency_ms,
    count(*) FILTER (WHERE status = 'error') AS error_count,
    count(*) FILTER (WHERE status = 'cancelled') AS cancelled_count,
    count(*) FILTER (WHERE blocked) AS blocked_count,
    CAST(sum(coalesce(tokens_in, 0)) AS BIGINT) AS total_tokens_in,
    CAST(sum(coalesce(tokens_out, 0)) AS BIGINT) AS total_tokens_out,
    CAST(sum(coalesce(estimated_cost_usd, 0)) AS DECIMAL(30,8)) AS total_cost_usd
  FROM logs WHERE completed_at IS NOT NULL GROUP BY ALL),
messages AS (
  SELECT conv_id AS conversation_id, turn AS seq, role, text AS content,
    CASE WHEN role = 'assistant' AND conv_id % 7 = 0 THEN 'interrupted' ELSE 'completed' END
      AS status,
    TIMESTAMP '2024-01-01' + (conv_id * 3600 + turn * 30) * INTERVAL 1 SECOND AS created_at
  FROM conversations),
told AS (
  SELECT * REPLACE (created_at - CASE WHEN role = 'assistant' THEN INTERVAL 40 SECOND
    ELSE INTERVAL 0 SECOND END AS created_at) FROM messages),
prompts AS (
  SELECT conversation_id, seq, prompt FROM (
    SELECT conversation_id, seq, role, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (
      PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS prompt
    FROM messages) WHERE role = 'assistant'),
opening AS (
  SELECT conversation_id, role, content FROM messages
  QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, seq) = 1),
conversation_rows AS (
  SELECT conversation_id, 'user-' || (conversation_id % 10) AS user_id,
    CASE WHEN o.role = 'user' THEN left(o.content, 28)
      || CASE WHEN length(o.content) > 28 THEN '…' ELSE '' END END AS title,
    'active' AS status, m.created_at, m.updated_at
  FROM (SELECT conversation_id, min(created_at) AS created_at, max(created_at) AS updated_at
        FROM messages GROUP BY ALL) m JOIN opening o USING (conversation_id)),
previews AS (
  SELECT c.*, left(d.text, 200) AS prompt_preview
  FROM calls c LEFT JOIN documents d ON d.doc_id = c.event_id % (SELECT count(*) FROM documents)),
spans AS (
  SELECT event_id AS request_id, started_at, completed_at
    + CASE WHEN event_id % 3 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS ended_at
  FROM calls),
requests AS (
  SELECT 'c' || m.conversation_id || '-t' || seq AS request_id, conversation_id, seq, created_at,
    provider, model, content
  FROM messages m JOIN registry r ON r.pos = m.conversation_id % 11 WHERE role = 'user'),
turns AS (
  SELECT 'c' || conversation_id || '-t' || seq AS request_id, conversation_id, seq, created_at,
    content, ['anthropic', 'openai', 'gemini', 'llama'][conversation_id % 4 + 1] AS provider,
    string_split(content, ' ') AS words,
    CASE WHEN conversation_id % 5 = 3 THEN 'cancelled' WHEN conversation_id % 11 = 7 THEN 'error'
    END AS control
  FROM messages WHERE role = 'assistant'),
words AS (
  SELECT t.*, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS w FROM turns t),
tokens AS (
  SELECT request_id, provider, created_at, w + 2 AS seq, 0 AS part,
    CASE WHEN w > 0 THEN ' ' || word ELSE word END AS content
  FROM words WHERE w > 0 OR word <> ''),
frames AS (
  SELECT request_id, 1 AS seq, 0 AS part, 'metadata' AS type, 50 + turns.seq AS input_tokens,
    NULL AS output_tokens FROM turns WHERE provider = 'anthropic'
  UNION ALL SELECT request_id, len(words) + 10, 0, 'metadata', NULL, len(words)
    FROM turns WHERE provider = 'anthropic'
  UNION ALL SELECT request_id, len(words) + 10, 0, 'metadata', 50 + seq, len(words)
    FROM turns WHERE provider IN ('openai', 'gemini')
  UNION ALL SELECT request_id, len(words) + 11, 0, 'done', NULL, NULL
    FROM turns WHERE provider IN ('anthropic', 'openai')
  UNION ALL SELECT request_id, len(words) + 10, 1, 'done', NULL, NULL
    FROM turns WHERE provider = 'gemini'
  UNION ALL SELECT request_id, len(words) + 10, 0, 'done', NULL, NULL
    FROM turns WHERE provider = 'llama'),
chunks AS (
  SELECT request_id, seq, part, 'token' AS type, content, NULL::INTEGER AS input_tokens,
    NULL::INTEGER AS output_tokens FROM tokens
  UNION ALL SELECT request_id, seq, part, type, NULL, input_tokens, output_tokens FROM frames),
summaries AS (
  SELECT t.request_id, t.conversation_id, t.provider, t.created_at, t.content, t.control,
    (SELECT min(k.seq) FROM tokens k WHERE k.request_id = t.request_id) AS first_seq,
    (SELECT count(*) FROM tokens k WHERE k.request_id = t.request_id) AS stream_chunks,
    CASE WHEN control IS NOT NULL THEN len(words) + 20
      WHEN provider IN ('anthropic', 'openai') THEN len(words) + 11
      ELSE len(words) + 10 END AS last_seq,
    CASE WHEN provider <> 'llama' THEN 50 + seq END AS tokens_in,
    CASE WHEN provider <> 'llama' THEN len(words) END AS tokens_out
  FROM turns t),
turn_context AS (
  SELECT conversation_id, seq, role, content,
    CAST(sum(length(content)) OVER (PARTITION BY conversation_id ORDER BY seq
      ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS BIGINT) AS context_chars
  FROM messages),
budget AS (
  SELECT conversation_id, seq, context_chars, context_chars // 4 AS context_tokens,
    context_chars // 4 > 200 AS over_budget
  FROM turn_context WHERE role = 'user'),
decisions AS (
  SELECT *, CASE WHEN over_rate THEN 'rate_limit_exceeded'
    WHEN over_budget THEN 'token_budget_exceeded' END AS block_reason
  FROM (SELECT *, row_number() OVER (
          PARTITION BY conversation_id, epoch_us(created_at) // 120000000
          ORDER BY created_at, request_id) > 1 AS over_rate
        FROM requests JOIN budget USING (conversation_id, seq))),
odd AS (
  SELECT p.*, event_id % 101 AS o,
    CASE event_id % 101
      WHEN 0 THEN 'payload: not JSON' WHEN 1 THEN 'provider: missing'
      WHEN 3 THEN 'status: invalid' WHEN 7 THEN 'tokens_out: invalid'
      WHEN 8 THEN 'started_at: invalid' WHEN 9 THEN 'model: invalid'
      WHEN 11 THEN 'tokens_in: out of range' WHEN 12 THEN 'metadata: invalid'
      WHEN 13 THEN 'conversation_id: invalid' WHEN 14 THEN 'stream_chunks: invalid'
    END AS reject_reason
  FROM previews p)"""


def _uuid(prefix: str, number: str) -> str:
    digits = f"md5('{prefix}' || {number})"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr({digits}, {a}, {n})" for a, n in cuts)


def _rate(part: str, whole: str, places: int) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN round_even(CAST({part} AS DOUBLE) / {whole}, {places}) "
        "ELSE 0.0::DOUBLE END"
    )


def _percentile(column: str, p: float) -> str:
    return f"round_even(quantile_cont({column}, {p}), 2)"


def _percentiles(window: str, at: str = "created_at", more: str = "", label: str = "") -> str:
    cells = ", ".join(
        f"{_percentile(col, p)} AS {m}_{name}"
        for m, col in (("dur", "duration_ms"), ("ttft", "ttft_ms"))
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    )
    return f"""SELECT {label}{cells},
  round_even(CAST(sum(tokens_per_second) AS DOUBLE) / count(tokens_per_second), 2) AS avg_tps,
  count(*) AS sample_size
FROM logs WHERE {at} > TIMESTAMP '{AS_OF}' - INTERVAL {window}
  AND status = 'success' AND duration_ms IS NOT NULL{more}"""

# Calls whose payload is stored, which arrived when they began.
_STORED = " AND event_id IN (SELECT event_id FROM odd WHERE reject_reason IS NULL)"



_ACTIVE = f"""(SELECT count(*) FROM spans WHERE started_at <= TIMESTAMP '{AS_OF}'
  AND started_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND ended_at > TIMESTAMP '{AS_OF}')"""


def _overview(label: str, window: str, active: str) -> str:
    return f"""SELECT '{label}' AS "window", n AS total_requests, e AS total_errors,
  c AS total_cancelled, b AS total_blocked,
  CASE WHEN n > 0 THEN round_even(1 - CAST(e + c AS DOUBLE) / n, 4) ELSE 0.0 END AS success_rate,
  {_rate('e', 'n', 4)} AS error_rate, {_rate('c', 'n', 4)} AS cancellation_rate,
  {_rate('l', 'n', 2)} AS avg_latency_ms, cost AS total_cost_usd,
  ti AS total_tokens_in, tout AS total_tokens_out, {active} AS active_streams
FROM (SELECT CAST(coalesce(sum(request_count), 0) AS BIGINT) AS n,
    CAST(coalesce(sum(error_count), 0) AS BIGINT) AS e,
    CAST(coalesce(sum(cancelled_count), 0) AS BIGINT) AS c,
    CAST(coalesce(sum(blocked_count), 0) AS BIGINT) AS b,
    CAST(coalesce(sum(total_latency_ms), 0) AS BIGINT) AS l,
    CAST(coalesce(sum(total_cost_usd), 0) AS DOUBLE) AS cost,
    CAST(coalesce(sum(total_tokens_in), 0) AS BIGINT) AS ti,
    CAST(coalesce(sum(total_tokens_out), 0) AS BIGINT) AS tout
  FROM rollup WHERE hour_bucket > TIMESTAMP '{AS_OF}' - INTERVAL {window})"""


_HOURS = f"""(SELECT hour_bucket, CAST(sum(request_count) AS BIGINT) AS requests,
    CAST(sum(error_count) AS BIGINT) AS errors, CAST(sum(cancelled_count) AS BIGINT) AS cancelled,
    CAST(sum(total_latency_ms) AS BIGINT) AS l, CAST(sum(total_cost_usd) AS DOUBLE) AS cost,
    CAST(sum(total_tokens_out) AS BIGINT) AS tokens_out
  FROM rollup WHERE hour_bucket > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY ALL)"""

_LOG_COLUMNS = """event_id, conversation_id, provider, model, started_at, completed_at,
  duration_ms, ttft_ms, tokens_per_second, tokens_in, tokens_out, estimated_cost_usd, status,
  blocked, block_reason, created_at"""

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' " \
    "ELSE strftime({0}, '.%f') END || '+00:00'"


def _iso(column: str) -> str:
    return f"{_ISO.format(column)} AS {column}"


# Redaction.  RE2's \b knows ASCII letters only, so for the digit patterns every other letter is
# wrapped in a marked ASCII letter first, which makes its edges word edges, and unwrapped after.
# The e-mail pattern runs before the wrapping: it consists of ASCII letters itself.
_LETTER = r"([\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02C1}" \
    r"\x{0370}-\x{1FFF}\x{3040}-\x{D7FF}])"
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_PHONE = r"\b(?:\+?\d{1,3}(?:S|-)?)?\(?\d{3,4}\)?(?:S|-)?\d{3,4}(?:S|-)?\d{3,4}\b".replace(
    "S", _SPACE
)
_CARD = r"\b(?:\d[ -]?){13,19}\b"
_AADHAAR = r"\b\d{4}S?\d{4}S?\d{4}\b".replace("S", _SPACE)
_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
_OPEN, _CLOSE = "Z", "Z"


def redaction(column: str) -> str:
    out = f"regexp_replace({column}, '{_EMAIL}', '<EMAIL_REDACTED>', 'g')"
    out = f"regexp_replace({out}, '{_LETTER}', '{_OPEN}\\1{_CLOSE}', 'g')"
    for label, pattern in (
        ("PHONE", _PHONE), ("CARD", _CARD), ("AADHAAR", _AADHAAR), ("SSN", _SSN)
    ):
        out = f"regexp_replace({out}, '{pattern}', '<{label}_REDACTED>', 'g')"
    return f"replace(replace({out}, '{_OPEN}', ''), '{_CLOSE}', '')"


_EARLY = "TIMESTAMP '2024-01-22'"

_QUERIES = {
    "registry_usage": """SELECT provider, model, context_window, 1024 AS max_tokens_default,
  true AS supports_streaming, (SELECT count(*) FROM calls c WHERE c.model = r.model) AS calls
FROM registry r""",
    "unpriced_usage": """SELECT provider, model, count(*) AS calls,
  CAST(sum(tokens_in) AS BIGINT) AS tokens_in
FROM calls WHERE model NOT IN (SELECT model FROM prices) GROUP BY ALL""",
    "table_scan_counts": """SELECT 'inference_logs' AS source, count(*) AS n,
  min(started_at) AS first_at, max(started_at) AS last_at FROM calls
UNION ALL SELECT 'messages', count(*), min(created_at), max(created_at) FROM messages""",
    "decode_accepted": f"""SELECT event_id AS "offset",
  CASE WHEN o = 5 THEN 'derived' ELSE {_uuid('event-', 'event_id')} END AS event_id,
  {_uuid('request-', 'event_id')} AS request_id,
  CASE WHEN conversation_id IS NOT NULL THEN {_uuid('conversation-', 'conversation_id')} END
    AS conversation_id,
  provider, model, started_at, completed_at, duration_ms, tokens_in, tokens_out, status, blocked,
  false AS streamed, 0 AS stream_chunks,
  CASE WHEN o = 15 THEN '' ELSE prompt_preview END AS prompt_preview,
  CASE o WHEN 16 THEN '{{"pii_detected":true}}'
    WHEN 17 THEN '{{"pii_detected":false,"region":"eu"}}' ELSE '{{}}' END AS metadata
FROM odd WHERE reject_reason IS NULL""",
    "decode_rejected": """SELECT event_id AS "offset", reject_reason FROM odd
WHERE reject_reason IS NOT NULL""",
    "reject_summary": """SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS n
FROM odd GROUP BY ALL""",
    "unknown_conversations": f"""SELECT event_id AS "offset",
  {_uuid('conversation-', 'conversation_id')} AS conversation_id
FROM odd WHERE reject_reason IS NULL AND conversation_id IS NOT NULL
  AND conversation_id NOT IN (SELECT conv_id FROM conversations)""",
    "referential_split": """SELECT conversation_id IS NULL
  OR conversation_id IN (SELECT conv_id FROM conversations) AS kept,
  count(*) AS n, count(conversation_id) AS with_conversation FROM calls GROUP BY 1""",
    "publish_roundtrip": """SELECT provider, status, count(*) AS n,
  CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
  CAST(sum(length(CASE WHEN o = 15 THEN '' ELSE prompt_preview END)) AS BIGINT) AS preview_chars
FROM odd WHERE reject_reason IS NULL GROUP BY ALL""",
    "derived_timings": """SELECT event_id, completed_at,
  CAST(trunc((e - s) * 1000) AS INTEGER) AS duration_ms,
  CAST(trunc((f - s) * 1000) AS INTEGER) AS ttft_ms,
  CASE WHEN trunc((e - s) * 1000) > 0 AND tokens_out <> 0 THEN CAST(CAST(round_even(
    tokens_out / trunc((e - s) * 1000) * 1000, 2) AS DECIMAL(10,2)) AS DOUBLE)
  END AS tokens_per_second
FROM (SELECT *, epoch_us(started_at) / 1e6 AS s, epoch_us(completed_at) / 1e6 AS e,
    epoch_us(started_at + ttft_ms * INTERVAL 1 MILLISECOND) / 1e6 AS f FROM calls)""",
    "priced_events": """SELECT event_id, model, CAST(estimated_cost_usd AS DOUBLE) AS cost_usd
FROM logs""",
    "redacted_documents": f"""SELECT doc_id, redacted, redacted <> text AS pii_found
FROM (SELECT doc_id, text, {redaction('text')} AS redacted FROM documents)""",
    "enriched_calls": f"""SELECT event_id, redacted AS prompt_preview, reply AS response_preview,
  redacted <> prompt_preview OR reply <> response OR event_id % 17 = 0 AS pii_detected,
  CASE WHEN redacted <> prompt_preview OR reply <> response
    THEN CASE event_id % 17 WHEN 2 THEN '{{"k":1,"pii_detected":true}}' ELSE '{{"pii_detected":true}}' END
    ELSE CASE event_id % 17 WHEN 0 THEN '{{"pii_detected":true}}' WHEN 1 THEN '{{"pii_detected":false}}'
      WHEN 2 THEN '{{"k":1}}' ELSE '{{}}' END END AS metadata,
  CAST(estimated_cost_usd AS DOUBLE) AS cost_usd
FROM (SELECT *, {redaction('prompt_preview')} AS redacted, {redaction('response')} AS reply FROM (
  SELECT event_id, coalesce(prompt_preview, '') AS prompt_preview, CASE WHEN event_id % 2 = 0 THEN 're: ' || coalesce(prompt_preview, '')
    WHEN event_id % 7 = 0 THEN 'mail x.y@example.org' ELSE '' END AS response FROM previews))
JOIN (SELECT event_id, estimated_cost_usd FROM logs) USING (event_id)""",
    "chunk_types": """SELECT provider, type, count(*) AS n
FROM chunks JOIN turns USING (request_id) GROUP BY ALL""",
    "normalised_chunks": """SELECT request_id, CAST(seq AS BIGINT) AS seq, part, type, content,
  input_tokens, output_tokens FROM chunks""",
    "classified_responses": """SELECT request_id, provider,
  CASE WHEN conversation_id % 9 <> 4 AND conversation_id % 13 <> 5 AND provider = 'anthropic'
    THEN 'served' ELSE 'asked' END AS model,
  CASE WHEN conversation_id % 9 = 4 THEN 'ERROR' ELSE 'SUCCESS' END AS action_status,
  CASE WHEN conversation_id % 9 = 4 THEN NULL
    WHEN conversation_id % 13 = 5 THEN 'No content returned' ELSE content END AS content,
  CASE WHEN conversation_id % 9 = 4 THEN NULL
    WHEN conversation_id % 13 = 5 OR provider = 'llama' THEN 0 ELSE 50 + seq END AS input_tokens,
  CASE WHEN conversation_id % 9 = 4 THEN NULL
    WHEN conversation_id % 13 = 5 OR provider = 'llama' THEN 0 ELSE length(content) END
    AS output_tokens,
  CASE WHEN conversation_id % 9 = 4 THEN 'upstream failed' END AS error_message
FROM turns""",
    "response_events": """SELECT 'e-' || request_id AS event_id, t.provider,
  CASE WHEN conversation_id % 9 <> 4 AND conversation_id % 13 <> 5 AND t.provider = 'anthropic'
    THEN 'served' ELSE 'asked' END AS model,
  CASE WHEN conversation_id % 9 = 4 THEN 'error' ELSE 'success' END AS status, false AS streamed,
  CAST(length(content) // 10 * 1000 AS INTEGER) AS duration_ms,
  CASE WHEN conversation_id % 9 = 4 THEN NULL
    WHEN conversation_id % 13 = 5 OR t.provider = 'llama' THEN 0 ELSE 50 + seq END AS tokens_in,
  CASE WHEN conversation_id % 9 = 4 THEN NULL
    WHEN conversation_id % 13 = 5 OR t.provider = 'llama' THEN 0 ELSE length(content) END AS tokens_out,
  CASE WHEN conversation_id % 9 = 4 THEN 'upstream failed' END AS error_message,
  left(coalesce(prompt, ''), 200) AS prompt_preview,
  CASE WHEN conversation_id % 9 = 4 THEN '' WHEN conversation_id % 13 = 5 THEN 'No content returned'
    ELSE left(content, 200) END AS response_preview
FROM turns t JOIN prompts USING (conversation_id, seq)""",
    "call_prompts": "SELECT * FROM prompts",
    "gemini_requests": """SELECT conversation_id, seq,
  CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END AS role, content
FROM messages WHERE role IN ('user', 'assistant')""",
    "chunk_validity": """SELECT known, type, count(*) AS n FROM (
  SELECT true AS known, type FROM chunks
  UNION ALL SELECT control = 'cancelled', CASE control WHEN 'error' THEN 'oops' ELSE control END
  FROM turns WHERE control IS NOT NULL) GROUP BY ALL""",
    "stream_summaries": """SELECT request_id,
  created_at + first_seq * INTERVAL 50 MILLISECOND AS first_token_ts,
  created_at + last_seq * INTERVAL 50 MILLISECOND AS last_ts,
  stream_chunks, tokens_in, tokens_out, coalesce(control, 'success') AS status,
  CASE WHEN control = 'error' THEN 'upstream reset' END AS error_message
FROM summaries""",
    "assembled_events": """SELECT request_id, provider, coalesce(control, 'success') AS status,
  CAST(trunc((e - s) * 1000) AS INTEGER) AS duration_ms,
  CAST(trunc((f - s) * 1000) AS INTEGER) AS ttft_ms, stream_chunks, tokens_in, tokens_out,
  left(content, 200) AS response_preview
FROM (SELECT *, epoch_us(created_at) / 1e6 AS s,
    epoch_us(created_at + last_seq * INTERVAL 50 MILLISECOND) / 1e6 AS e,
    epoch_us(created_at + first_seq * INTERVAL 50 MILLISECOND) / 1e6 AS f FROM summaries)""",
    "assembled_replies": """SELECT request_id, content,
  CASE control WHEN 'cancelled' THEN 'interrupted' ELSE 'completed' END AS status
FROM turns WHERE control = 'cancelled' OR (control IS NULL AND content <> '')""",
    "hourly_rollup": "SELECT * FROM rollup",
    "rollup_merge": "SELECT * FROM rollup",
    "rollup_rebuild": "SELECT * FROM rollup",
    "five_minute_latency": """SELECT time_bucket(INTERVAL 5 MINUTE, completed_at) AS bucket,
  count(*) AS requests, CAST(sum(duration_ms) AS BIGINT) AS total_latency_ms,
  max(duration_ms) AS max_latency_ms FROM logs GROUP BY ALL""",
    "overview": _overview("30d", "30 DAY", _ACTIVE),
    "overview_24h": _overview("24h", "24 HOUR", "0"),
    "timeseries": f"""SELECT hour_bucket AS "timestamp", requests, errors, cancelled,
  {_rate('l', 'requests', 2)} AS avg_latency_ms, cost AS total_cost_usd, tokens_out
FROM {_HOURS} ORDER BY 1""",
    "requests_by_status": f"""SELECT hour_bucket AS "timestamp",
  requests - errors - cancelled AS success, errors, cancelled, requests FROM {_HOURS}""",
    "provider_breakdown": f"""SELECT provider, model, requests, errors, cancelled,
  {_rate('errors', 'requests', 4)} AS error_rate, {_rate('l', 'requests', 2)} AS avg_latency_ms,
  cost AS total_cost_usd, tokens_in, tokens_out
FROM (SELECT provider, model, CAST(sum(request_count) AS BIGINT) AS requests,
    CAST(sum(error_count) AS BIGINT) AS errors, CAST(sum(cancelled_count) AS BIGINT) AS cancelled,
    CAST(sum(total_latency_ms) AS BIGINT) AS l, CAST(sum(total_cost_usd) AS DOUBLE) AS cost,
    CAST(sum(total_tokens_in) AS BIGINT) AS tokens_in,
    CAST(sum(total_tokens_out) AS BIGINT) AS tokens_out
  FROM rollup WHERE hour_bucket > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY ALL)
ORDER BY requests DESC, provider, model""",
    "latency_percentiles": _percentiles("30 DAY"),
    "latency_percentiles_24h": _percentiles("24 HOUR"),
    "provider_latency": f"""SELECT provider,
  {_rate('sum(ttft_ms)', 'count(ttft_ms)', 2)} AS avg_first_token_latency_ms,
  {_rate('sum(duration_ms)', 'count(duration_ms)', 2)} AS avg_completion_latency_ms,
  {_percentile('duration_ms', 0.95)} AS p95_latency_ms FROM logs GROUP BY ALL""",
    "provider_tokens": f"""SELECT provider, ti AS total_input_tokens, tout AS total_output_tokens,
  {_rate('(ti + tout)', 'n', 2)} AS avg_tokens_per_request,
  round_even(tout * 1000 / l, 2) AS tokens_per_second
FROM (SELECT provider, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS ti,
    CAST(sum(tokens_out) AS BIGINT) AS tout, CAST(sum(duration_ms) AS BIGINT) AS l
  FROM logs GROUP BY ALL)""",
    "provider_cost": """SELECT provider, cost AS total_cost,
  round_even(cost / n, 6) AS avg_cost_per_request
FROM (SELECT provider, count(*) AS n,
    CAST(coalesce(sum(estimated_cost_usd), 0) AS DOUBLE) AS cost FROM logs GROUP BY ALL)""",
    "stream_metrics": f"""SELECT {_ACTIVE} AS active_streams,
  count(*) FILTER (WHERE status = 'cancelled') AS cancelled_streams,
  {_rate('sum(duration_ms)', 'count(duration_ms)', 2)} AS avg_stream_duration_ms FROM logs""",
    "request_metrics": f"""SELECT *, {_rate('success_count', 'total_requests', 4)} AS success_rate
FROM (SELECT count(*) AS total_requests,
    count(*) FILTER (WHERE status = 'success') AS success_count,
    count(*) FILTER (WHERE status IN ('error', 'timeout')) AS failure_count,
    count(*) FILTER (WHERE status = 'cancelled') AS cancelled_count FROM logs)""",
    "blocked_by_reason": """SELECT block_reason, count(*) AS blocked_count FROM logs
WHERE blocked GROUP BY ALL""",
    "latency_sketch": """SELECT provider, count(*) AS n, true AS p50_close, true AS p95_close,
  true AS p99_close FROM logs WHERE status = 'success' GROUP BY ALL""",
    "recent_logs": f"SELECT {_LOG_COLUMNS} FROM logs ORDER BY created_at DESC, event_id LIMIT 50",
    "recent_logs_filtered": f"""SELECT {_LOG_COLUMNS} FROM logs
WHERE status = 'success' AND provider = 'openai' ORDER BY created_at DESC, event_id LIMIT 500""",
    "recent_logs_serialised": f"""SELECT CAST(event_id AS VARCHAR) AS event_id,
  CAST(conversation_id AS VARCHAR) AS conversation_id, provider, model, {_iso('started_at')},
  {_iso('completed_at')}, duration_ms, ttft_ms,
  CAST(tokens_per_second AS DOUBLE) AS tokens_per_second, tokens_in, tokens_out,
  CAST(estimated_cost_usd AS DOUBLE) AS estimated_cost_usd, status, blocked, block_reason,
  {_iso('created_at')}
FROM (SELECT * FROM logs WHERE status = 'error' ORDER BY created_at DESC, event_id LIMIT 100)""",
    "blocked_events": """SELECT event_id, provider, model, block_reason, created_at FROM logs
WHERE blocked ORDER BY created_at DESC, event_id""",
    "recent_buffer": """SELECT event_id, completed_at AS emitted_at, status FROM calls
ORDER BY completed_at DESC, event_id LIMIT 200""",
    "conversation_list": """SELECT * EXCLUDE (m), CASE WHEN m < 1 THEN 'just now'
  WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago'
  ELSE strftime(updated_at, '%Y-%m-%d') END AS age
FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2024-01-02 06:00:00') - epoch_us(updated_at))
    / 60000000) AS BIGINT) AS m FROM conversation_rows WHERE user_id = 'user-3'
  ORDER BY updated_at DESC, conversation_id LIMIT 50)""",
    "rate_limited": """SELECT event_id, epoch_us(started_at) // 86400000000 AS rate_bucket,
  row_number() OVER (PARTITION BY user_id, epoch_us(started_at) // 86400000000
    ORDER BY started_at, event_id) > 2 AS over_rate FROM calls""",
    "token_budget": """SELECT conversation_id, seq, context_chars, context_chars // 4 AS context_tokens,
  context_chars // 4 > 200 AS over_budget FROM (
  SELECT conversation_id, seq, role, CAST(sum(length(coalesce(content, ''))) OVER (
    PARTITION BY conversation_id ORDER BY created_at, seq
    ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS BIGINT) AS context_chars FROM told)
WHERE role = 'user'""",
    "budget_by_words": """SELECT request_id, context_tokens, CASE WHEN over_rate THEN 'rate_limit_exceeded'
  WHEN context_tokens > 200 THEN 'token_budget_exceeded' END AS block_reason
FROM (SELECT conversation_id, seq, CAST(sum(length(coalesce(content, ''))) OVER (
    PARTITION BY conversation_id ORDER BY created_at, seq
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) // 3 AS context_tokens FROM messages)
JOIN (SELECT request_id, conversation_id, seq, over_rate FROM decisions) USING (conversation_id, seq)""",
    "one_conversation": """SELECT conversation_id, seq, role, content, status FROM told
WHERE conversation_id = 3 QUALIFY row_number() OVER (ORDER BY created_at DESC, seq DESC) <= 4""",
    "readmitted_events": f"""SELECT event_id AS "offset",
  CASE WHEN reject_reason IS NULL
    AND substr({_uuid('conversation-', 'conversation_id')}, 1, 1) <= '7' THEN 'again' ELSE 'kept' END AS outcome
FROM odd WHERE reject_reason IS NOT NULL OR (conversation_id IS NOT NULL
  AND conversation_id NOT IN (SELECT conv_id FROM conversations))""",
    "governance_decisions": "SELECT request_id, over_rate, block_reason FROM decisions",
    "blocked_call_events": """SELECT request_id,
  CAST(conversation_id AS VARCHAR) AS conversation_id, provider, model, created_at AS started_at,
  created_at AS completed_at, 0 AS duration_ms, CAST(NULL AS INTEGER) AS tokens_in,
  'error' AS status, true AS blocked, block_reason,
  CASE block_reason
    WHEN 'rate_limit_exceeded'
    THEN 'Rate limit exceeded: max 1 requests/minute per conversation.'
    ELSE 'Input too large: estimated ' || context_tokens || ' tokens exceeds the 200-token limit. '
      || 'Shorten your message or start a new conversation.' END AS error_message,
  left(content, 200) AS prompt_preview
FROM decisions WHERE block_reason IS NOT NULL""",
    "merged_event_stream": """SELECT streamed, status, blocked, count(*) AS n FROM (
  SELECT true AS streamed, coalesce(control, 'success') AS status, false AS blocked FROM turns
  UNION ALL SELECT false, CASE WHEN conversation_id % 9 = 4 THEN 'error' ELSE 'success' END, false FROM turns
  UNION ALL SELECT false, 'error', true FROM decisions WHERE block_reason IS NOT NULL)
GROUP BY ALL""",
    "message_history": """SELECT conversation_id, seq, role, content, status FROM told
QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, seq DESC) <= 3""",
    "context_windows": """SELECT conversation_id, seq, n_messages, context FROM (
  SELECT conversation_id, seq, role,
    CAST(count(*) OVER w AS INTEGER) AS n_messages,
    string_agg(role || ': ' || content, chr(10)) OVER w AS context
  FROM told WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, seq
    ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE role = 'user'""",
    "prompt_sources": """SELECT conversation_id, seq, left(content, 200) AS prompt_preview
FROM messages WHERE role = 'user'
QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) = 1""",
    "message_order": """SELECT conversation_id, seq, row_number() OVER (
    PARTITION BY conversation_id ORDER BY created_at, seq) - 1 AS position FROM told""",
    "conversation_table": "SELECT * FROM conversation_rows",
    "conversation_messages": """SELECT conversation_id, seq, role, content, title, user_id
FROM messages JOIN conversation_rows USING (conversation_id)""",
    "usage_by_user": """SELECT user_id, count(*) AS requests,
  CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in,
  CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out,
  CAST(coalesce(sum(estimated_cost_usd), 0) AS DOUBLE) AS total_cost_usd
FROM (SELECT * EXCLUDE (user_id) FROM logs) l
JOIN conversation_rows r ON r.conversation_id = l.conversation_id GROUP BY ALL""",
    "cascade_delete": """SELECT conversation_id, seq, role, status FROM messages
WHERE conversation_id % 4 <> 1""",
    "detach_deleted": """SELECT event_id, CASE WHEN conversation_id % 4 = 1
    AND conversation_id IN (SELECT conv_id FROM conversations) THEN NULL
    ELSE conversation_id END AS conversation_id FROM calls""",
    "create_missing": f"""SELECT * FROM conversation_rows
UNION ALL SELECT DISTINCT conversation_id, 'default-user', NULL, 'active',
  TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}' FROM calls
WHERE conversation_id NOT IN (SELECT conv_id FROM conversations)""",
    "append_messages": """SELECT * FROM messages
UNION ALL SELECT conversation_id, max(seq) + 1, 'user', 'thanks, that is all', 'completed',
  max(created_at) + INTERVAL 30 SECOND FROM messages GROUP BY conversation_id""",
    "conversation_updates": """SELECT conversation_id, user_id, coalesce(t, title) AS title,
  coalesce(s, status) AS status, created_at, greatest(updated_at, u) AS updated_at
FROM conversation_rows LEFT JOIN (
  SELECT conversation_id,
    arg_max('call ' || event_id, created_at) FILTER (WHERE event_id % 5 = 0) AS t,
    max('cancelled') FILTER (WHERE status = 'cancelled') AS s,
    max(created_at) FILTER (WHERE event_id % 2 = 0) AS u
  FROM calls WHERE conversation_id IS NOT NULL GROUP BY 1) USING (conversation_id)""",
    "evolved_columns": """SELECT CASE WHEN seq < 2 THEN 'completed' ELSE status END AS status,
  count(*) AS n, CAST(0 AS BIGINT) AS blocked_count FROM messages GROUP BY 1""",
    "first_deliveries": "SELECT event_id, 1 AS delivery, status, duration_ms FROM calls",
    "unseen_events": f"""SELECT event_id, 1 AS delivery, created_at FROM calls
WHERE created_at >= {_EARLY}
UNION ALL SELECT event_id, 2, created_at FROM calls
WHERE created_at >= {_EARLY} AND event_id % 50 = 0""",
    "active_streams": f"""SELECT request_id, started_at FROM spans
WHERE started_at <= TIMESTAMP '{AS_OF}' AND started_at > TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR
  AND ended_at > TIMESTAMP '{AS_OF}'""",
    "cancel_matches": f"""SELECT {_uuid('request-', 'c.event_id')} AS request_id,
  c.started_at + (c.event_id % 7) * INTERVAL 1 SECOND AS cancel_ts
FROM calls c JOIN spans s ON s.request_id = c.event_id
WHERE c.event_id % 10 <> 9
  AND c.started_at + (c.event_id % 7) * INTERVAL 1 SECOND <= s.ended_at""",
    "replayed_rate_limit": """SELECT CAST(event_id AS VARCHAR) AS request_id, row_number() OVER (
    PARTITION BY user_id, epoch_us(started_at) // 86400000000
    ORDER BY event_id % 2, epoch_us(started_at), CAST(event_id AS VARCHAR)) > 2 AS over_rate FROM calls""",
    "stored_detach": f"""SELECT provider, status, count(*) AS n,
  count(*) FILTER (WHERE right({_uuid('conversation-', 'conversation_id')}, 1) >= '5') AS attached
FROM logs WHERE event_id IN (SELECT event_id FROM odd WHERE reject_reason IS NULL) GROUP BY ALL""",
    "streamed_ingest": """SELECT date_trunc('hour', completed_at) AS hour_bucket, provider, model,
  count(*) AS request_count, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS total_latency_ms,
  count(*) FILTER (WHERE status = 'error') AS error_count,
  count(*) FILTER (WHERE status = 'cancelled') AS cancelled_count,
  count(*) FILTER (WHERE blocked) AS blocked_count,
  CAST(sum(coalesce(tokens_in, 0)) AS BIGINT) AS total_tokens_in,
  CAST(sum(coalesce(tokens_out, 0)) AS BIGINT) AS total_tokens_out,
  CAST(sum(coalesce(estimated_cost_usd, 0)) AS DECIMAL(30,8)) AS total_cost_usd
FROM logs WHERE event_id IN (SELECT event_id FROM odd WHERE reject_reason IS NULL)
GROUP BY ALL""",
    "stored_window": f"""SELECT provider, status, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, "copy"
FROM logs, (VALUES ('stored'), ('compacted')) c("copy")
WHERE event_id IN (SELECT event_id FROM odd WHERE reject_reason IS NULL)
  AND started_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY GROUP BY ALL""",
    "fanned_out": """SELECT sink, n FROM (
  SELECT 'files' AS sink, count(*) AS n FROM calls UNION ALL SELECT 'json', count(*) FROM calls
  UNION ALL SELECT 'recent', least(count(*), 200) FROM calls
  UNION ALL SELECT 'failures', 2) ORDER BY 1""",
    "fanned_out_recovered": """SELECT sink, status, count(*) AS n
FROM calls, (VALUES ('late'), ('steady')) AS sinks(sink) GROUP BY ALL""",
    "served_percentiles": " UNION ALL ".join(
        _percentiles(window, "started_at", _STORED, f"""'{label}' AS "window", """) for label, window in (("100m", "100 MINUTE"), ("24h", "24 HOUR"), ("30d", "30 DAY"))
    ),
    "compacted_dates": """SELECT provider, status, CAST(started_at AS DATE) AS day, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
FROM logs WHERE event_id IN (SELECT event_id FROM odd WHERE reject_reason IS NULL) GROUP BY ALL""",
    "served_tables": """SELECT provider, model, count(*) AS requests FROM logs
WHERE event_id IN (SELECT event_id FROM odd WHERE reject_reason IS NULL) GROUP BY ALL""",
    "streamed_dedup": "SELECT event_id, status FROM calls",
    "tracked_streams": """SELECT CAST(request_id AS VARCHAR) AS request_id, 'registered' AS change
FROM spans UNION ALL SELECT CAST(request_id AS VARCHAR),
  CASE WHEN epoch_ms(ended_at) - epoch_ms(started_at) > 3600000 THEN 'expired' ELSE 'ended' END
FROM spans""",
    "streamed_rate_limit": """SELECT CAST(user_id AS VARCHAR) AS conversation_id, rate_bucket,
  over_rate, count(*) AS n FROM (
  SELECT user_id, epoch_us(started_at) // 86400000000 AS rate_bucket, row_number() OVER (
    PARTITION BY user_id, epoch_us(started_at) // 86400000000 ORDER BY started_at) > 2 AS over_rate
  FROM calls) GROUP BY ALL""",
    "streamed_token_bucket": """SELECT request_id, conversation_id, over_rate FROM bucket WHERE n > 0""",
    "streamed_cancels": """SELECT CAST(c.event_id AS VARCHAR) AS request_id,
  min(c.started_at + (c.event_id % 7) * INTERVAL 1 SECOND + again * INTERVAL 2 HOUR) AS cancel_ts
FROM calls c JOIN spans s ON s.request_id = c.event_id, (VALUES (0), (1)) r(again)
WHERE c.started_at + (c.event_id % 7) * INTERVAL 1 SECOND + again * INTERVAL 2 HOUR <= s.ended_at
  AND (again = 0 OR c.event_id % 3 = 0) GROUP BY c.event_id""",
    "malformed_cancels": """SELECT event_id, 'garbage-' || status AS payload FROM calls
WHERE event_id % 10 = 9""",
}


# A token bucket decides one call after the other: a step of the recursion takes every user's next one.
_BUCKET = """,
turn AS (SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(user_id AS VARCHAR) AS conversation_id,
    epoch_us(started_at) // 1000 AS at_ms, row_number() OVER (
      PARTITION BY user_id ORDER BY epoch_us(started_at) // 1000, CAST(event_id AS VARCHAR)) AS n FROM calls),
bucket(n, request_id, conversation_id, at_ms, tokens, over_rate) AS (
  SELECT 0, '', conversation_id, min(at_ms), 2.0::DOUBLE, false FROM turn GROUP BY conversation_id
  UNION ALL
  SELECT t.n, t.request_id, t.conversation_id, t.at_ms,
    least(2.0::DOUBLE, b.tokens + (t.at_ms - b.at_ms) / 1000.0::DOUBLE * (1 / 256.0::DOUBLE / 60.0::DOUBLE))
      - CASE WHEN least(2.0::DOUBLE, b.tokens + (t.at_ms - b.at_ms) / 1000.0::DOUBLE * (1 / 256.0::DOUBLE / 60.0::DOUBLE)) < 1 THEN 0 ELSE 1 END,
    least(2.0::DOUBLE, b.tokens + (t.at_ms - b.at_ms) / 1000.0::DOUBLE * (1 / 256.0::DOUBLE / 60.0::DOUBLE)) < 1
  FROM bucket b JOIN turn t ON t.conversation_id = b.conversation_id AND t.n = b.n + 1)"""


#: Stored tables give what the same changes give in memory, and a batch job what its streamed form gives.
_SAME = {
    "bucketed_calls": "streamed_token_bucket", "replayed_streams": "tracked_streams", "replayed_cancels": "streamed_cancels",
    "stored_updates": "conversation_updates", "stored_creates": "create_missing", "stored_cascade": "cascade_delete",
}


def oracle_sql() -> dict[str, str]:
    extra = {"streamed_token_bucket": _BUCKET, "bucketed_calls": _BUCKET}
    every = {**_QUERIES, **{name: _QUERIES[other] for name, other in _SAME.items()}}
    return {name: f"WITH RECURSIVE {_BASE}{extra.get(name, '')}\n{sql}" for name, sql in every.items()}
