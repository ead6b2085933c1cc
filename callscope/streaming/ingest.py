"""The ingest job: payloads to raw log, rollup and dead letters, each batch exactly once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators.decode import (
    check_conversations,
    decode_events,
    fit_to_log,
    split_rejects,
    to_log_rows,
)
from callscope.operators.enrich import (
    Stage,
    business_rules,
    check_costs,
    enrich,
    price_stage,
    redact_previews,
)
from callscope.operators.matching import first_arrivals
from callscope.schemas import LOG_EVENT_SCHEMA
from callscope.session import scratch_dir, short_methods
from callscope.sources.files import hadoop_path
from callscope.sources.lookups import load_prices
from callscope.sources.tables import Warehouse

Tables = Callable[[], DataFrame]


def check_payloads(
    raw: DataFrame, conversations: DataFrame | None = None, prices: DataFrame | None = None
) -> DataFrame:
    """Decode and range check; given prices also the cost, given conversations also references."""
    checked = fit_to_log(decode_events(raw))
    if prices is not None:
        checked = check_costs(checked, prices)
    return checked if conversations is None else check_conversations(checked, conversations)


def standard_stages(spark, prices: DataFrame | None = None) -> list[Stage]:
    """Rules, redaction, pricing, in this order."""
    return [
        business_rules,
        redact_previews,
        price_stage(load_prices(spark) if prices is None else prices),
    ]


def ingest_batch(
    raw: DataFrame,
    batch_id: int,
    warehouse: Warehouse,
    stages: Sequence[Stage] | None = None,
    conversations: DataFrame | None = None,
    created_at: Column | None = None,
    sketches: bool = False,
) -> None:
    """Write one batch of payloads (`payload`, optionally `arrival`) to the warehouse.

    An event counts once however often it is delivered: copies inside the batch collapse to the
    first arrival, and ids stored by other batches are left out.  These are looked up in the index of
    ids, in the buckets of the batch's own ids; the log is not read, unless it has no index
    yet.  `sketches` also keeps latency sketches per hour, provider and model.  The rollup's share is
    computed from the rows as stored, so both tables always hold the same events, and since
    every table's batch folder is replaced whole, a repeated batch changes nothing.

    Decoded events lie in a scratch folder while the batch runs, so passes over them read the columns that they need.
    """
    with short_methods(raw.sparkSession):
        _ingest(raw, batch_id, warehouse, stages, conversations, created_at, sketches)


def _ingest(raw, batch_id, warehouse, stages, conversations, created_at, sketches) -> None:
    spark = raw.sparkSession
    if created_at is None:
        created_at = F.lit(warehouse.batch_time(batch_id))
    # The payload's hash settles ties, so a repeated batch keeps the same copies.
    order = [F.col("arrival")] if "arrival" in raw.columns else []
    raw = raw.withColumn("arrival", F.struct(*order, F.xxhash64("payload").alias("tie")))
    decoded = check_payloads(raw, prices=load_prices(spark) if stages is None else None)
    if conversations is None:  # nothing is rejected later, so good events are done with their payload
        decoded = decoded.withColumn("payload", F.when(F.col("reject_reason").isNotNull(), F.col("payload")))
    aside = scratch_dir(spark, "decoded")
    try:
        decoded.write.parquet(aside)
        decoded = spark.read.schema(decoded.schema).parquet(aside)
        checked = decoded if conversations is None else check_conversations(decoded, conversations)
        accepted, rejected = split_rejects(checked)
        warehouse.write("dead_letters", rejected.select("payload", "reject_reason"), batch_id)

        key, index = warehouse.batch_key(batch_id), warehouse.event_ids()
        if not index.exists():
            index.build(warehouse.logs().where(F.col("batch") != F.lit(key)))
        fresh = first_arrivals(accepted, "arrival")
        new = fresh.join(index.among(accepted, key), "event_id", "left_anti")
        chain = standard_stages(spark) if stages is None else stages
        rows = to_log_rows(enrich(new.select(*LOG_EVENT_SCHEMA.names), chain), created_at)
        stored = warehouse.append_logs(rows, batch_id)
        index.add(stored, key)
        warehouse.add_to_rollup(stored, batch_id)
        warehouse.add_values(stored, batch_id)
        if sketches:
            warehouse.add_sketches(stored, batch_id)

        kept = stored.agg(F.count(F.lit(1))).scalar()
        counts = checked.agg(
            F.count(F.lit(1)).alias("input_rows"),
            kept.alias("accepted_rows"),
            F.count("reject_reason").alias("rejected_rows"),
        ).withColumn(
            "duplicate_rows",
            F.col("input_rows") - F.col("accepted_rows") - F.col("rejected_rows"),
        )
        warehouse.write("ingest_batches", counts, batch_id)
    finally:
        path, system = hadoop_path(spark, aside)
        system.delete(path, True)


def run_ingest(
    stream: DataFrame,
    warehouse: Warehouse,
    checkpoint: str,
    conversations: Tables | None = None,
    stages: Sequence[Stage] | None = None,
    every: str | None = None,
    after_batch: Callable[[Warehouse, int], None] | None = None,
    created_at: Column | None = None,
    sketches: bool = False,
):
    """Start the ingest query.

    Offsets are committed after a batch is written, so a crash repeats the batch and the repeat
    is harmless.  Late events simply add to their old hour; nothing is dropped for lateness.
    `every` is a processing-time trigger; without it, what is there is processed and the query
    ends.  `after_batch` refreshes whatever is served from the tables.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        known = conversations() if conversations else None
        ingest_batch(
            batch, batch_id, warehouse, stages, known, created_at, sketches
        )
        if after_batch:
            after_batch(warehouse, batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def within_horizon(events: DataFrame, event_time: str, horizon: str) -> DataFrame:
    """Optional first filter of a stream: drop repeats of an id inside the horizon in state.

    Repeats beyond it are still caught against the stored log.
    """
    return events.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["event_id"])


def watermarked_rollup(events: DataFrame, lateness: str) -> DataFrame:
    """Append-mode hourly rollup for readers that accept a lateness bound.

    Unlike the ingest job it drops what arrives later than `lateness`.
    """
    timely = events.withWatermark("completed_at", lateness)
    zero = F.lit(0)
    return (
        timely.groupBy(F.window("completed_at", "1 hour").alias("w"), "provider", "model")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.sum(F.coalesce("duration_ms", zero)).alias("total_latency_ms"),
            F.count(F.when(F.col("status") == "error", True)).alias("error_count"),
            F.count(F.when(F.col("status") == "cancelled", True)).alias("cancelled_count"),
            F.count(F.when(F.col("blocked"), True)).alias("blocked_count"),
        )
        .select(F.col("w.start").alias("hour_bucket"), "*")
        .drop("w")
    )
