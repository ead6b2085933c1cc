"""Wire contract: lenient and strict spellings, defaults, ranges, rejects."""

from __future__ import annotations

import json
from uuid import UUID

import pytest
from pyspark.sql import functions as F

from callscope.operators.decode import (
    decode_events,
    fit_to_log,
    split_rejects,
    to_log_rows,
    to_wire,
)
from callscope.operators.enrich import enrich
from callscope.schemas import INFERENCE_LOG_SCHEMA
from callscope.streaming.ingest import standard_stages

RID = "00000000-0000-0000-0000-00000000000a"
BASE = {"request_id": RID, "provider": "openai", "model": "gpt-4o", "started_at": 1.5}


def check(spark, *docs):
    texts = [d if isinstance(d, str) or d is None else json.dumps(d) for d in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    return fit_to_log(decode_events(df)).orderBy("i").collect()


def with_(**changes):
    return {**BASE, **changes}


GOOD = [
    (with_(tokens_in="12"), "tokens_in", 12),
    (with_(tokens_in=12.0), "tokens_in", 12),
    (with_(tokens_in=True), "tokens_in", 1),
    (with_(started_at="2.5"), "started_at", 2.5),
    (with_(blocked="yes"), "blocked", True),
    (with_(blocked=0), "blocked", False),
    (with_(streamed="OFF"), "streamed", False),
    (with_(status="timeout"), "status", "timeout"),
    (with_(conversation_id=None), "conversation_id", None),
    (with_(request_id=RID.upper().replace("-", "")), "request_id", RID),
    (with_(tokens_out=None), "tokens_out", None),
    (with_(metadata={"a": [1]}), "metadata", '{"a":[1]}'),
    (BASE, "status", "success"),
    (BASE, "stream_chunks", 0),
    (BASE, "prompt_preview", ""),
    (BASE, "metadata", "{}"),
    (with_(unknown={"x": 1}), "provider", "openai"),
    (with_(prompt_preview="naïve \"q\" \n é"), "prompt_preview", "naïve \"q\" \n é"),
]
BAD = [
    ("{oops", "payload: not JSON"),
    ("", "payload: not JSON"),
    (None, "payload: not JSON"),
    ("[1]", "payload: not JSON"),
    ({k: v for k, v in BASE.items() if k != "provider"}, "provider: missing"),
    (with_(provider=None), "provider: invalid"),
    (with_(provider=12), "provider: invalid"),
    (with_(request_id="zz"), "request_id: invalid"),
    (with_(event_id=None), "event_id: invalid"),
    (with_(started_at="soon"), "started_at: invalid"),
    (with_(started_at="1.5d"), "started_at: invalid"),
    (with_(started_at=1e13), "started_at: out of range"),
    (with_(tokens_in=1.5), "tokens_in: invalid"),
    (with_(tokens_in="1e3"), "tokens_in: invalid"),
    (with_(tokens_in=2**31), "tokens_in: out of range"),
    (with_(status="done"), "status: invalid"),
    (with_(status=None), "status: invalid"),
    (with_(blocked="maybe"), "blocked: invalid"),
    (with_(blocked=2), "blocked: invalid"),
    (with_(metadata=[1]), "metadata: invalid"),
    (with_(metadata=None), "metadata: invalid"),
    (with_(estimated_cost_usd=10_000.0), "estimated_cost_usd: out of range"),
]


def test_accepted_spellings(spark):
    got = check(spark, *[g[0] for g in GOOD])
    for row, (doc, name, want) in zip(got, GOOD):
        assert row.reject_reason is None, (doc, row.reject_reason)
        assert row[name] == want, doc


def test_rejected_spellings(spark):
    got = check(spark, *[b[0] for b in BAD])
    assert [(r.payload, r.reject_reason) for r in got] == [
        (r.payload, b[1]) for r, b in zip(got, BAD)
    ]


def test_missing_id_is_stable(spark):
    a, b, c = check(spark, BASE, BASE, with_(model="x"))
    assert a.event_id == b.event_id != c.event_id
    assert len(a.event_id) == 36


def test_split_is_complete_and_rows_fit_the_log(spark):
    docs = [g[0] for g in GOOD] + [b[0] for b in BAD]
    texts = [d if isinstance(d, str) or d is None else json.dumps(d) for d in docs]
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    accepted, rejected = split_rejects(fit_to_log(decode_events(df)))
    assert (accepted.count(), rejected.count()) == (len(GOOD), len(BAD))
    rows = to_log_rows(enrich(accepted, standard_stages(spark)))
    assert rows.schema.simpleString() == INFERENCE_LOG_SCHEMA.simpleString()
    again = decode_events(to_wire(accepted).select(F.col("value").alias("payload")))
    assert again.where("reject_reason is not null").count() == 0


@pytest.mark.parametrize("name", ["duration_ms", "completed_at", "error_message"])
def test_optional_fields_may_be_null(spark, name):
    assert check(spark, with_(**{name: None}))[0].reject_reason is None


def test_letters_are_decoded_once(spark, tmp_path, monkeypatch):
    """The rows that are looked up come from storage: no plan after it parses a payload."""
    from callscope.operators import decode

    rows = [(n, json.dumps({"request_id": str(UUID(int=n)), "provider": "p", "model": "m", "started_at": 1.0, "conversation_id": str(UUID(int=n % 3))}), "conversation_id: unknown") for n in range(9)]
    letters = spark.createDataFrame([*rows, (9, "{broken", "payload: not JSON")], "offset long, payload string, reject_reason string")
    known = spark.createDataFrame([(str(UUID(int=1)),)], "conversation_id string")
    looked_up = []
    plain = decode.check_conversations
    monkeypatch.setattr(decode, "check_conversations", lambda rows, ids: looked_up.append(rows) or plain(rows, ids))
    again, kept = decode.readmit(letters, known)
    assert "from_json" not in looked_up[0]._jdf.queryExecution().optimizedPlan().toString()
    assert again.columns == ["offset", "payload"] and kept.columns == ["offset", "payload", "reject_reason"]
    assert sorted(r.offset for r in again.collect()) == [1, 4, 7]
    assert sorted((r.offset, r.reject_reason) for r in kept.collect()) == [(n, "conversation_id: unknown") for n in (0, 2, 3, 5, 6, 8)] + [(9, "payload: not JSON")]
