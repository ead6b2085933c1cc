"""Skew-safe helpers against brute force, with one key holding a third of the rows."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import keyed
from callscope.operators.governance import flag_over_budget, flag_rate_limited
from callscope.operators.matching import first_arrivals, unseen
from callscope.operators.percentiles import exact_percentiles


@pytest.fixture(scope="module", params=["adaptive", "shuffled"], autouse=True)
def joins(spark, request):
    """Run everything twice: as planned for small data, and with plain shuffle joins only."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    if request.param == "shuffled":
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


@pytest.fixture(scope="module")
def skewed(spark, joins):
    rng = random.Random(7)
    rows = []
    for key in range(40):
        size = 300 if key == 0 else rng.randint(1, 30)
        seqs = rng.sample(range(size * (3 if key % 2 else 1)), size)
        rows += [(key, s, rng.choice(["user", "assistant"]), "x" * rng.randint(0, 90)) for s in seqs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conversation_id int, seq long, role string, content string")
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    return df.repartition(5), {k: sorted(v, key=lambda r: r[1]) for k, v in groups.items()}


@pytest.mark.parametrize("n", [1, 5, 20])
def test_last_n(skewed, n):
    df, groups = skewed
    got = {(r.conversation_id, r.seq) for r in keyed.last_n_per_key(df, ["conversation_id"], ["seq"], n).collect()}
    assert got == {(k, r[1]) for k, v in groups.items() for r in v[-n:]}


@pytest.mark.parametrize("segment", [1, 7, 50, 100_000])
@pytest.mark.parametrize("n", [3, 20])
def test_lookback(skewed, segment, n):
    df, groups = skewed
    cut = keyed.with_lookback(df, "conversation_id", "seq", n, segment)
    frame = keyed.lookback_window("conversation_id", "seq", n)
    got = (
        cut.withColumn("seqs", F.collect_list("seq").over(frame))
        .where(~F.col("_carried"))
        .select("conversation_id", "seq", "seqs")
        .collect()
    )
    want = {
        (k, v[i][1]): [r[1] for r in v[max(0, i - n) : i + 1]]
        for k, v in groups.items()
        for i in range(len(v))
    }
    assert len(got) == len(want)
    assert {(r.conversation_id, r.seq): r.seqs for r in got} == want


def test_positions(skewed):
    df, groups = skewed
    numbered = keyed.position_in_key(df, "conversation_id", ["seq"]).collect()
    want = {(k, r[1]): i for k, v in groups.items() for i, r in enumerate(v)}
    assert {(r.conversation_id, r.seq): r.position for r in numbered} == want


def test_budget(skewed):
    df, groups = skewed
    got = {
        (r.conversation_id, r.seq): (r.context_chars, r.over_budget)
        for r in flag_over_budget(df, max_tokens=150).collect()
    }
    want = {}
    for k, v in groups.items():
        for i, r in enumerate(v):
            if r[2] == "user":
                chars = sum(len(x[3]) for x in v[max(0, i - 20) : i + 1])
                want[(k, r[1])] = (chars, chars // 4 > 150)
    assert got == want


def test_rate_limit_with_a_hot_bucket(spark):
    rng = random.Random(3)
    rows = [(f"r{i:04d}", "hot" if i % 3 == 0 else f"c{i % 17}", rng.randint(0, 299)) for i in range(900)]
    df = spark.createDataFrame(rows, "request_id string, conversation_id string, s int").select(
        "request_id", "conversation_id", F.timestamp_seconds("s").alias("started_at")
    )
    got = {r.request_id: r.over_rate for r in flag_rate_limited(df.repartition(6), 20).collect()}
    buckets = defaultdict(list)
    for rid, c, s in rows:
        buckets[(c, s // 60)].append((s, rid))
    want = {rid: i >= 20 for b in buckets.values() for i, (_, rid) in enumerate(sorted(b))}
    assert got == want and any(want.values())


def test_first_arrivals_with_many_copies(spark):
    rows = [(1, i, f"v{i}") for i in range(500, 0, -1)] + [(n, 5, "x") for n in range(2, 50)]
    df = spark.createDataFrame(rows, "event_id int, arrival int, payload string").repartition(7)
    got = {r.event_id: (r.arrival, r.payload) for r in first_arrivals(df, "arrival").collect()}
    assert len(got) == 49 and got[1] == (1, "v1")
    stored = spark.createDataFrame([(n,) for n in range(0, 40, 2)], "event_id int")
    left = {r.event_id for r in unseen(df, stored).collect()}
    assert left == {n for n in range(1, 50) if n % 2 or n >= 40}


def test_skew_join_splits_a_hot_key(spark, joins):
    """With tiny thresholds the adaptive skew join takes part, and results stay the same."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {n: spark.conf.get(n) for n in conf}
    for n, value in conf.items():
        spark.conf.set(n, value)
    try:
        rows = [(i, "hot" if i % 3 else f"c{i}") for i in range(3000)]
        df = spark.createDataFrame(rows, "seq long, k string").repartition(12)
        got = keyed.last_n_per_key(df, ["k"], ["seq"], 700)
        kept = got.collect()
        assert len(kept) == 1000 + 700
        assert min(r.seq for r in kept if r.k == "hot") == sorted(
            i for i, k in rows if k == "hot"
        )[-700]
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {
        "one": np.array([5]),
        "two": np.array([70_000, -3]),
        "wide": rng.integers(-(2**31), 2**31 - 1, 999),
        "same": np.full(500, 123_456),
        "small": rng.integers(0, 300, 1000),
    }
    rows = [(g, int(x)) for g, xs in groups.items() for x in xs] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(4)
    fractions = [0.0, 0.5, 0.95, 0.99, 1.0]
    got = exact_percentiles(df, "x", fractions, ["g"]).collect()
    assert len(got) == len(groups) * len(fractions)
    for r in got:
        assert r.value == pytest.approx(np.quantile(groups[r.g], r.fraction), rel=1e-12, abs=1e-6)
        assert r.n == len(groups[r.g])
