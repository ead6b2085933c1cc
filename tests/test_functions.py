"""Column functions against hand-computed values."""

from __future__ import annotations

import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from callscope.functions import cost, identity, pii, text, timing
from callscope.operators.enrich import enrich, pii_stage, price_events, redact_previews
from callscope.sources.lookups import load_prices, load_registry, unpriced_models

PII_CASES = [
    (
        "Write to ann.lee@mail.example or call 212-555-0147 today",
        "Write to <EMAIL_REDACTED> or call <PHONE_REDACTED> today",
    ),
    ("4111 1111 1111 1111", "<PHONE_REDACTED> 1111"),
    ("pay 4111-1111-1111-1111.", "pay <PHONE_REDACTED>-1111."),
    ("4111111111111111 x", "<CARD_REDACTED>x"),
    ("1234 5678 9012", "<PHONE_REDACTED>"),
    ("123-45-6789", "<SSN_REDACTED>"),
    ("+1 (743) 555-3824", "+<PHONE_REDACTED>"),
    ("(555) 867-5309", "(<PHONE_REDACTED>"),
    ("order 1700000000123 ok", "order <PHONE_REDACTED> ok"),
    ("é5558675309", "é5558675309"),
    ("naïve.user@example.com", "naïve<EMAIL_REDACTED>"),
    ("12345678901234567890", "12345678901234567890"),
    ("٥٥٥-٨٦٧-٥٣٠٩", "<PHONE_REDACTED>"),
    ("555 867 5309", "<PHONE_REDACTED>"),
    ("nothing here", "nothing here"),
    ("", ""),
]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return row.select(column.alias("x")).collect()[0][0]


def test_pii_table(spark):
    df = spark.createDataFrame(PII_CASES, "t string, want string")
    got = df.select("t", "want", pii.redact(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_pii_equals_python_on_documents(spark, sf):
    compiled = [(label, re.compile(p)) for label, p in pii.PII_PATTERNS]

    def slow(t):
        for label, p in compiled:
            t = p.sub(f"<{label}_REDACTED>", t)
        return t

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in docs.select("text", pii.redact(F.col("text")).alias("got")).collect():
        assert r.got == slow(r.text)


def test_preview_redaction_and_flag(spark):
    rows = [
        ("call 555-867-5309", "", "{}"),
        ("clean", "a@b.org", '{"region":"eu","pii_detected":false}'),
        ("clean", "clean", '{"pii_detected":true}'),
        ("clean", "clean", '{"pii_detected":"yes"}'),
        ("clean", "clean", '{"pii_detected":0}'),
        ("clean", "", "{}"),
    ]
    df = spark.createDataFrame(rows, "prompt_preview string, response_preview string, metadata string")
    got = redact_previews(df.coalesce(1)).collect()
    assert [r.pii_detected for r in got] == [True, True, True, True, False, False]
    assert got[0].metadata == '{"pii_detected":true}'
    assert got[1].metadata == '{"pii_detected":true,"region":"eu"}' or (
        got[1].metadata == '{"region":"eu","pii_detected":true}'
    )
    own = enrich(df.limit(1), [pii_stage([("WORD", "call")])]).collect()[0]
    assert own.prompt_preview == "<WORD_REDACTED> 555-867-5309"


@pytest.mark.parametrize(
    "start,end,want", [(10.0, 11.9999, 1999), (0.0, 5.0, None), (10.0, 0.0, None), (10.0, 9.5, -500)]
)
def test_duration(spark, start, end, want):
    assert one(spark, timing.duration_ms(F.col("s"), F.col("e")), s=start, e=end) == want


def test_tokens_per_second(spark):
    rate = timing.tokens_per_second(F.col("t"), F.col("d"))
    assert one(spark, rate, t=10, d=1500) == Decimal("6.67")
    assert one(spark, rate, t=0, d=1500) is None
    assert one(spark, rate, t=10, d=0) is None


def test_epoch_rounds_to_micros(spark):
    ts = timing.epoch_to_timestamp(F.col("e")).cast("timestamp_ntz")
    assert one(spark, ts, e=1700000000.123457) == datetime(2023, 11, 14, 22, 13, 20, 123457)


@pytest.mark.parametrize("bad", ["", "h", "1w", "-1h", "1.5h", "1 h", "24H"])
def test_bad_windows(bad):
    with pytest.raises(ValueError):
        timing.window_seconds(bad)


def test_windows():
    assert [timing.window_seconds(w) for w in ("15m", "24h", "7d", "0h")] == [900, 86400, 604800, 0]


@pytest.mark.parametrize(
    "at,want",
    [
        ("2024-01-02 05:59:30", "just now"),
        ("2024-01-02 05:01:00", "59m ago"),
        ("2024-01-02 05:00:00", "1h ago"),
        ("2024-01-01 06:00:01", "23h ago"),
        ("2024-01-01 06:00:00", "2024-01-01"),
    ],
)
def test_age_label(spark, at, want):
    label = timing.age_label(F.col("t").cast("timestamp"), "2024-01-02 06:00:00")
    assert one(spark, label, t=at) == want


def test_titles_and_estimates(spark):
    assert one(spark, text.title(F.col("t")), t="a" * 28) == "a" * 28
    assert one(spark, text.title(F.col("t")), t="é" * 29) == "é" * 28 + "…"
    assert one(spark, text.preview(F.col("t")), t="x" * 300) == "x" * 200
    assert one(spark, text.estimated_tokens(F.col("n")), n=45000) == 11250
    assert one(spark, text.estimated_tokens(F.col("n")), n=7) == 1


def test_cost(spark):
    c = cost.token_cost(F.col("i"), F.col("o"), F.lit("0.075"), F.lit("0.30"))
    assert one(spark, c, i=1_000_000, o=1_000_000) == Decimal("0.37500000")
    assert one(spark, c, i=1, o=0) == Decimal("0.00000008")  # 7.5e-8, tie to even
    assert one(spark, c, i=3, o=0) == Decimal("0.00000022")  # 22.5e-8, tie to even
    prices = load_prices(spark)
    calls = spark.createDataFrame(
        [("gpt-4o", None, None, None), ("other", 5, 5, None), ("other", 5, 5, Decimal("1.5"))],
        "model string, tokens_in int, tokens_out int, estimated_cost_usd decimal(12,8)",
    )
    got = [r.estimated_cost_usd for r in price_events(calls, prices).orderBy("model").collect()]
    assert got[0] == 0 and sorted(got[1:], key=str) == [Decimal("1.50000000"), None]


def test_registry_and_prices(spark, tmp_path):
    registry, prices = load_registry(spark), load_prices(spark)
    assert registry.count() == 11 and prices.count() == 10
    missing = sorted(r.model for r in unpriced_models(registry, prices).collect())
    assert missing == ["llama3.1-70b", "llama3.1-8b"]
    (tmp_path / "r.json").write_text(
        '{"providers":[{"id":"p","name":"P","models":[{"id":"m","context_window":5}]}]}'
    )
    own = load_registry(spark, str(tmp_path / "r.json")).collect()
    assert [(r.provider, r.model, r.context_window) for r in own] == [("p", "m", 5)]
    (tmp_path / "p.csv").write_text("model,input_rate,output_rate\nm,1.5,2.25\n")
    assert load_prices(spark, str(tmp_path / "p.csv")).collect()[0].output_rate == Decimal("2.250")


def test_canonical_uuid(spark):
    good = "0123ABCD-0123-4567-89ab-0123456789AB"
    forms = [good, good.replace("-", ""), "{" + good + "}", "urn:uuid:" + good]
    for form in forms:
        got = one(spark, identity.canonical_uuid(F.col("u")), u=form)
        assert got == good.lower()
    for bad in ("", "x", good[:-1], good + "0", good.replace("-", "", 1)):
        assert one(spark, identity.canonical_uuid(F.col("u")), u=bad) is None
