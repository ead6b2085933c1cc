"""No task gets most of a hot key's rows, and batch token buckets against a plain loop."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from callscope.catalog import views
from callscope.operators import conversations, keyed
from callscope.operators.decode import check_conversations
from callscope.operators.governance import flag_rate_limited, flag_token_bucket

ROWS = 60_000


@pytest.fixture
def shuffled(spark):
    """Shuffle joins only, and partitions that are not put together because they are small."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "48"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, value in conf.items():
        spark.conf.set(k, value)
    yield spark
    for k, value in before.items():
        spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def hot(spark):
    """Four fifths of the rows on one key, the others on 500 keys."""
    n = F.col("id")
    return spark.range(0, ROWS, 1, 6).select(
        F.when(n % 5 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (n % 500).cast("string"))).alias("conversation_id"),
        n.cast("string").alias("request_id"),
        F.timestamp_seconds(n % 60).alias("started_at"),
        n.alias("seq"),
    )


def largest_share(df):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_rate_limit_spreads_a_hot_bucket(shuffled):
    flagged = flag_rate_limited(hot(shuffled), 20, 60)
    assert flagged.where("over_rate and conversation_id = 'hot'").count() == ROWS * 4 // 5 - 20
    assert largest_share(flagged) < 0.2


def test_last_rows_spread_a_hot_key(shuffled):
    kept = keyed.last_n_per_key(hot(shuffled), ["conversation_id"], ["seq"], ROWS * 3 // 4)
    assert kept.count() == ROWS // 5 + ROWS * 3 // 4
    assert largest_share(kept) < 0.2


def test_positions_spread_a_hot_key_of_one_second(shuffled):
    """All rows have one time, so only the append order tells the tasks apart."""
    rows = hot(shuffled).withColumn("created_at", F.when(F.col("seq") % 9 > 0, F.timestamp_seconds(F.lit(60)))).drop("started_at", "request_id")
    rows = rows.withColumn("conversation_id", F.when(F.col("seq") != 35, F.col("conversation_id"))).repartition(6)
    numbered = conversations.number_messages(rows)
    assert largest_share(numbered) < 0.2
    got = {(r["conversation_id"], r["seq"]): r["position"] for r in numbered.collect()}
    want, met = {}, {}
    for key, _, seq in sorted(((r["conversation_id"], r["created_at"] is not None, r["seq"]) for r in rows.collect()), key=lambda r: r[1:]):
        want[key, seq] = met[key] = met.get(key, -1) + 1
    assert got == want and len(got) == ROWS
    assert conversations.number_messages(rows.limit(0)).count() == 0


def test_references_spread_a_hot_id(shuffled):
    checked = hot(shuffled).select("request_id", "conversation_id", F.lit(None).cast("string").alias("reject_reason"))
    checked = checked.withColumn("conversation_id", F.when(F.col("request_id").cast("int") % 7 > 0, F.col("conversation_id")))
    known = shuffled.createDataFrame([("hot",), ("hot",), ("k5",), ("other",)], "conversation_id string")
    out = check_conversations(checked, known)
    got = {(r["c"], r["reject_reason"]) for r in out.select(F.coalesce("conversation_id", F.lit("none")).alias("c"), "reject_reason").distinct().collect()}
    assert {c for c, reason in got if reason is None} == {"hot", "k5", "none"} and out.count() == ROWS
    assert all(reason == "conversation_id: unknown" for c, reason in got if c not in ("hot", "k5", "none"))
    assert largest_share(out) < 0.2


def plain_bucket(rows, capacity, per_minute):
    state, over = {}, {}
    for key, at, name in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        tokens, last = state.get(key, (float(capacity), at))
        tokens = min(float(capacity), tokens + (at - last) / timedelta(milliseconds=1) / 1000 * (per_minute / 60.0))
        over[name] = tokens < 1
        state[key] = tokens - (0 if over[name] else 1), at
    return over


@pytest.mark.parametrize("per_minute", [4, 12])
def test_token_bucket_in_batch(spark, per_minute):
    """A busy key, keys with pauses, requests at one time, repeated decisions, null keys and null times."""
    rng = random.Random(per_minute)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows, at = [], start
    for n in range(1500):
        at += timedelta(seconds=rng.choice([0, 1, 2, 8]) if n % 50 else 400)
        rows.append((rng.choice(["busy", "busy", "busy", "a", "b", "c", None]), at, f"r{n:05d}"))
    frame = spark.createDataFrame([(k, a, n, 1) for k, a, n in [*rows, ("a", None, "none")]], "conversation_id string, started_at timestamp, request_id string, _n int").repartition(5)
    got = {r["request_id"]: r["over_rate"] for r in flag_token_bucket(frame.drop("_n"), 3, per_minute).collect()}
    assert got.pop("none") is None
    assert got == plain_bucket(rows, 3, per_minute)
    assert {True, False} == set(got.values())
    assert flag_token_bucket(frame.drop("_n").limit(0), 3, per_minute).count() == 0


def test_payloads_of_one_file_are_made_by_all_tasks(spark, tmp_path):
    events = spark.range(0, 2000, 1, 1).selectExpr("id event_id", "timestamp_seconds(1704067200 + id) ts", "id user_id", "'view' event_type", "1.5D value", "'{\"k\": 1}' props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.range(0, 10, 1, 1).selectExpr("id doc_id", "'text' text").write.parquet(str(tmp_path / "documents.parquet"))
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        made = views.payloads(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set(conf, before)
    assert sum(r["count"] for r in made) == 2000 and max(r["count"] for r in made) < 1500
