"""Provider dialects and event assembly."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from callscope.operators import chunks as ch

LINES = {
    "anthropic": [
        '{"type":"message_start","message":{"usage":{"input_tokens":12}}}',
        '{"type":"content_block_delta","delta":{"text":"Hi"}}',
        '{"type":"content_block_delta","delta":{"text":""}}',
        '{"type":"message_delta","usage":{"output_tokens":5}}',
        '{"type":"message_stop"}',
    ],
    "openai": [
        '{"choices":[{"delta":{"content":"Hi"}}]}',
        '{"choices":[{"delta":{},"finish_reason":"stop"}]}',
        '{"choices":[],"usage":{"prompt_tokens":12,"completion_tokens":5}}',
        " [DONE] ",
    ],
    "gemini": [
        '{"candidates":[{"content":{"parts":[{"text":"Hi"}]},"finishReason":"STOP"}],'
        '"usageMetadata":{"promptTokenCount":12,"candidatesTokenCount":5}}'
    ],
    "llama": [
        '{"choices":[{"delta":{"content":"Hi"}}]}',
        '{"choices":[{"finish_reason":"stop"}]}',
    ],
}
T0 = datetime(2024, 1, 1)
SCHEMA = "request_id string, provider string, seq long, ts timestamp, line string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = []
    for provider, lines in LINES.items():
        noise = [": ping", "data: {broken", "event: x"]
        for i, line in enumerate(noise + [f"data: {x}" for x in lines]):
            rows.append((provider, provider, i, T0 + timedelta(seconds=i), line))
    return ch.normalise_lines(spark.createDataFrame(rows, SCHEMA))


def test_dialects(chunks):
    got = {}
    for r in chunks.orderBy("request_id", "seq", "part").collect():
        got.setdefault(r.request_id, []).append(
            (r.type, r.content, r.input_tokens, r.output_tokens)
        )
    token, done = ("token", "Hi", None, None), ("done", None, None, None)
    assert got["anthropic"] == [
        ("metadata", None, 12, None), token, ("metadata", None, None, 5), done,
    ]
    assert got["openai"] == [token, ("metadata", None, 12, 5), done]
    assert got["gemini"] == [token, ("metadata", None, 12, 5), done]
    assert got["llama"] == [token, done]


def test_events_of_all_dialects_agree(spark, chunks):
    requests = spark.createDataFrame(
        [(p, p, None, p, "m", T0.timestamp(), "hello") for p in LINES] +
        [("silent", "silent", None, "openai", "m", T0.timestamp(), "")],
        "event_id string, request_id string, conversation_id string, provider string, "
        "model string, started_at double, prompt_preview string",
    )
    events = {r.request_id: r for r in ch.assemble_events(requests, chunks).collect()}
    for p in LINES:
        assert events[p].response_preview == "Hi" and events[p].stream_chunks == 1
        assert events[p].status == "success"
        want = (None, None) if p == "llama" else (12, 5)
        assert (events[p].tokens_in, events[p].tokens_out) == want
    assert events["silent"].response_preview == "" and events["silent"].completed_at is None


def test_terminal_states_and_replies(spark):
    def row(rid, seq, kind, content=None, error=None):
        return (rid, seq, 0, T0, kind, content, error, None, None)

    rows = [
        row("ok", 1, "token", "a"), row("ok", 2, "token", "b"), row("ok", 3, "done"),
        row("cut", 1, "token", "x"), row("cut", 2, "cancelled"),
        row("cut0", 1, "cancelled"),
        row("bad", 1, "token", "y"), row("bad", 2, "error", None, "boom"),
        row("empty", 1, "done"),
    ]
    df = spark.createDataFrame(
        rows,
        "request_id string, seq long, part int, ts timestamp, type string, content string, "
        "error string, input_tokens int, output_tokens int",
    )
    summary = ch.summarise_streams(df).withColumn("status", ch.terminal_status())
    status = {r.request_id: (r.status, r.error_message) for r in summary.collect()}
    assert status == {
        "ok": ("success", None), "cut": ("cancelled", None), "cut0": ("cancelled", None),
        "bad": ("error", "boom"), "empty": ("success", None),
    }
    replies = {r.request_id: (r.content, r.status) for r in ch.assistant_messages(df, 2).collect()}
    assert replies == {
        "ok": ("ab", "completed"), "cut": ("x", "interrupted"), "cut0": ("", "interrupted"),
    }


def test_preview_stops_at_200_characters(spark):
    rows = [("r", i, 0, T0, "token", "ab", None, None, None) for i in range(500)]
    df = spark.createDataFrame(
        rows,
        "request_id string, seq long, part int, ts timestamp, type string, content string, "
        "error string, input_tokens int, output_tokens int",
    ).repartition(4)
    assert ch.response_previews(df).collect()[0].response_preview == "ab" * 100


def test_usage_keeps_the_last_value(spark):
    rows = [
        ("r", 1, 0, T0, "metadata", None, None, 5, 1),
        ("r", 2, 0, T0, "metadata", None, None, None, 9),
    ]
    df = spark.createDataFrame(
        rows,
        "request_id string, seq long, part int, ts timestamp, type string, content string, "
        "error string, input_tokens int, output_tokens int",
    )
    r = ch.summarise_streams(df).select("tokens_in", "tokens_out").collect()[0]
    assert tuple(r) == (5, 9)


def test_responses(spark):
    body = '{"content":[{"text":"hey"}],"usage":{"input_tokens":3}}'
    df = spark.createDataFrame(
        [
            ("a", "anthropic", "m", 200, body),
            ("b", "anthropic", "m", 204, ""),
            ("c", "openai", "m", 429, "slow down"),
        ],
        "request_id string, provider string, model string, status_code int, body string",
    )
    got = {r.request_id: r for r in ch.classify_responses(df).collect()}
    assert (got["a"].content, got["a"].input_tokens, got["a"].output_tokens) == ("hey", 3, 0)
    assert got["b"].content == "No content returned" and got["b"].action_status == "SUCCESS"
    assert got["c"].action_status == "ERROR" and got["c"].error_message == "slow down"


def test_gemini_usage_without_either_count(spark):
    """Usage that isn't empty is a chunk of its own, whatever it holds; empty or null usage is none."""
    lines = ['{"usageMetadata":{"totalTokenCount":9}}', '{"usageMetadata":{}}', '{"usageMetadata":null}', '{"usageMetadata":{"promptTokenCount":null}}']
    rows = [("g", "gemini", n, T0, f"data: {line}") for n, line in enumerate(lines)]
    found = ch.normalise_lines(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    assert [(r.seq, r.type, r.input_tokens, r.output_tokens) for r in found] == [(0, "metadata", None, None), (3, "metadata", None, None)]
