"""Dashboard metrics.

Sums come from the hourly rollup, percentiles from the raw log.  `as_of` replaces the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.timing import in_window
from callscope.operators.percentiles import histogram_percentiles, measured, value_histogram

PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long")


def ratio(part: Column, whole: Column, places: int) -> Column:
    """part / whole rounded half-even; 0 where there is nothing to divide by."""
    safe = part.cast("double") / F.when(whole != 0, whole.cast("double"))
    return F.when(whole > 0, F.bround(safe, places)).otherwise(F.lit(0.0))


def _rate(part: str) -> Column:
    return ratio(F.col(part), F.col("total_requests"), 4)


def rollup_window(rollup: DataFrame, window: str, as_of=None) -> DataFrame:
    """Rollup rows whose hour starts strictly after the window start."""
    return rollup.where(in_window(F.col("hour_bucket"), window, as_of))


def log_window(logs: DataFrame, window: str, as_of=None) -> DataFrame:
    """Log rows that arrived strictly after the window start."""
    return logs.where(in_window(F.col("created_at"), window, as_of))


def overview(
    rollup: DataFrame, window: str, as_of=None, active: DataFrame | None = None
) -> DataFrame:
    """One row of totals and rates; zeros when the window is empty.

    `active` is the table of live streams, counted into `active_streams`.
    """
    totals = rollup_window(rollup, window, as_of).agg(
        _total("request_count").alias("total_requests"),
        _total("error_count").alias("total_errors"),
        _total("cancelled_count").alias("total_cancelled"),
        _total("blocked_count").alias("total_blocked"),
        _total("total_latency_ms").alias("_latency"),
        F.coalesce(F.sum("total_cost_usd").cast("double"), F.lit(0.0)).alias("total_cost_usd"),
        _total("total_tokens_in").alias("total_tokens_in"),
        _total("total_tokens_out").alias("total_tokens_out"),
    )
    n = F.col("total_requests")
    unsuccessful = (F.col("total_errors") + F.col("total_cancelled")).cast("double")
    success = 1 - unsuccessful / F.when(n != 0, n.cast("double"))
    streams = F.lit(0).cast("long")
    if active is not None:
        streams = active.agg(F.count(F.lit(1))).scalar()
    return totals.select(
        F.lit(window).alias("window"),
        "total_requests",
        "total_errors",
        "total_cancelled",
        "total_blocked",
        F.when(n > 0, F.bround(success, 4)).otherwise(F.lit(0.0)).alias("success_rate"),
        _rate("total_errors").alias("error_rate"),
        _rate("total_cancelled").alias("cancellation_rate"),
        ratio(F.col("_latency"), n, 2).alias("avg_latency_ms"),
        "total_cost_usd",
        "total_tokens_in",
        "total_tokens_out",
        streams.alias("active_streams"),
    )


def timeseries(rollup: DataFrame, window: str, as_of=None) -> DataFrame:
    """One row per hour that has data, oldest first."""
    return (
        rollup_window(rollup, window, as_of)
        .groupBy("hour_bucket")
        .agg(
            _total("request_count").alias("requests"),
            _total("error_count").alias("errors"),
            _total("cancelled_count").alias("cancelled"),
            _total("total_latency_ms").alias("_latency"),
            F.sum("total_cost_usd").cast("double").alias("total_cost_usd"),
            _total("total_tokens_out").alias("tokens_out"),
        )
        .select(
            F.col("hour_bucket").alias("timestamp"),
            "requests",
            "errors",
            "cancelled",
            ratio(F.col("_latency"), F.col("requests"), 2).alias("avg_latency_ms"),
            "total_cost_usd",
            "tokens_out",
        )
        .orderBy("timestamp")
    )


def requests_by_status(rollup: DataFrame, window: str, as_of=None) -> DataFrame:
    """Stacked-chart data: success is what is neither error nor cancelled, so bars add up."""
    hours = timeseries(rollup, window, as_of)
    return hours.select(
        "timestamp",
        (F.col("requests") - F.col("errors") - F.col("cancelled")).alias("success"),
        "errors",
        "cancelled",
        "requests",
    )


def by_provider(rollup: DataFrame, window: str, as_of=None) -> DataFrame:
    """Breakdown by provider and model, busiest first."""
    return (
        rollup_window(rollup, window, as_of)
        .groupBy("provider", "model")
        .agg(
            _total("request_count").alias("requests"),
            _total("error_count").alias("errors"),
            _total("cancelled_count").alias("cancelled"),
            _total("total_latency_ms").alias("_latency"),
            F.sum("total_cost_usd").cast("double").alias("total_cost_usd"),
            _total("total_tokens_in").alias("tokens_in"),
            _total("total_tokens_out").alias("tokens_out"),
        )
        .select(
            "provider",
            "model",
            "requests",
            "errors",
            "cancelled",
            ratio(F.col("errors"), F.col("requests"), 4).alias("error_rate"),
            ratio(F.col("_latency"), F.col("requests"), 2).alias("avg_latency_ms"),
            "total_cost_usd",
            "tokens_in",
            "tokens_out",
        )
        .orderBy(F.col("requests").desc(), "provider", "model")
    )


def percentiles(logs: DataFrame, window: str, as_of=None) -> DataFrame:
    """One row: latency and first-token percentiles, mean output rate, sample size.

    The population is successful calls with a duration that arrived in the window.  An
    empty population gives nulls.
    """
    sample = measured(log_window(logs, window, as_of))
    return percentiles_of(value_histogram(sample, "x", ["measure"]))


def percentiles_of(hist: DataFrame) -> DataFrame:
    """The same row from a histogram by measure, such as the stored ones add up to.

    All figures come from it: output rates enter it in hundredths, so their mean is exact.
    """
    cells = histogram_percentiles(hist, list(PERCENTILES.values()), ["measure"])
    totals = hist.groupBy("measure").agg(
        (F.sum(F.col("v") * F.col("n")) / 100 / F.sum("n")).alias("value"),
        F.sum("n").alias("n"),
    )
    merged = cells.unionByName(totals.withColumn("fraction", F.lit(-1.0)))

    def cell(measure: str, fraction: float, name: str = "value") -> Column:
        hit = (F.col("measure") == measure) & (F.col("fraction") == fraction)
        return F.max(F.when(hit, F.col(name)))

    return merged.agg(
        *[
            F.bround(cell(m, p), 2).alias(f"{m}_{name}")
            for m in ("dur", "ttft")
            for name, p in PERCENTILES.items()
        ],
        F.bround(cell("rate", -1.0), 2).alias("avg_tps"),
        F.coalesce(cell("dur", -1.0, "n"), F.lit(0)).alias("sample_size"),
    )


def provider_latency(logs: DataFrame) -> DataFrame:
    """Mean first-token and completion latency and the p95 per provider, from one histogram."""
    keys = ["provider", "measure"]
    stacked = logs.select(
        "provider",
        F.explode(
            F.array(
                F.struct(F.lit("ttft").alias("measure"), F.col("ttft_ms").alias("x")),
                F.struct(F.lit("dur").alias("measure"), F.col("duration_ms").alias("x")),
            )
        ).alias("m"),
    ).select("provider", "m.measure", "m.x")
    hist = value_histogram(stacked, "x", keys)
    p95 = histogram_percentiles(hist, [0.95], keys).select(
        *keys, F.col("value").alias("p95"), F.lit(None).cast("double").alias("mean")
    )
    means = hist.groupBy(*keys).agg(
        F.lit(None).cast("double").alias("p95"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
    )

    def cell(measure: str, name: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(name)))

    return (
        p95.unionByName(means)
        .groupBy("provider")
        .agg(
            F.coalesce(F.bround(cell("ttft", "mean"), 2), F.lit(0.0)).alias(
                "avg_first_token_latency_ms"
            ),
            F.coalesce(F.bround(cell("dur", "mean"), 2), F.lit(0.0)).alias(
                "avg_completion_latency_ms"
            ),
            F.bround(cell("dur", "p95"), 2).alias("p95_latency_ms"),
        )
    )


def provider_tokens(logs: DataFrame) -> DataFrame:
    """Token totals per provider, mean per request, and output tokens per second of latency."""
    sums = logs.groupBy("provider").agg(
        _total("tokens_in").alias("total_input_tokens"),
        _total("tokens_out").alias("total_output_tokens"),
        _total("duration_ms").alias("_dur"),
        F.count(F.lit(1)).alias("_n"),
    )
    both = F.col("total_input_tokens") + F.col("total_output_tokens")
    out_rate = F.col("total_output_tokens") * 1000 / F.when(F.col("_dur") != 0, F.col("_dur"))
    return sums.select(
        "provider",
        "total_input_tokens",
        "total_output_tokens",
        ratio(both, F.col("_n"), 2).alias("avg_tokens_per_request"),
        F.bround(out_rate, 2).alias("tokens_per_second"),
    )


def provider_cost(logs: DataFrame) -> DataFrame:
    """Cost per provider, in total and per request."""
    sums = logs.groupBy("provider").agg(
        F.coalesce(F.sum("estimated_cost_usd").cast("double"), F.lit(0.0)).alias("total_cost"),
        F.count(F.lit(1)).alias("_n"),
    )
    return sums.select(
        "provider",
        "total_cost",
        F.bround(F.col("total_cost") / F.col("_n"), 6).alias("avg_cost_per_request"),
    )


def stream_metrics(logs: DataFrame, active: DataFrame) -> DataFrame:
    """Live and cancelled streams and the mean duration of finished ones."""
    sums = logs.agg(
        F.count(F.when(F.col("status") == "cancelled", True)).alias("cancelled_streams"),
        _total("duration_ms").alias("_dur"),
        F.count("duration_ms").alias("_n"),
    )
    return sums.select(
        active.agg(F.count(F.lit(1))).scalar().alias("active_streams"),
        "cancelled_streams",
        ratio(F.col("_dur"), F.col("_n"), 2).alias("avg_stream_duration_ms"),
    )


def request_metrics(logs: DataFrame) -> DataFrame:
    """Totals by outcome; a timeout is a failure here."""

    def n(*statuses: str) -> Column:
        return F.count(F.when(F.col("status").isin(*statuses), True))

    sums = logs.agg(
        F.count(F.lit(1)).alias("total_requests"),
        n("success").alias("success_count"),
        n("error", "timeout").alias("failure_count"),
        n("cancelled").alias("cancelled_count"),
    )
    return sums.select(
        "*", ratio(F.col("success_count"), F.col("total_requests"), 4).alias("success_rate")
    )


def blocked_by_reason(logs: DataFrame) -> DataFrame:
    return (
        logs.where(F.col("blocked"))
        .groupBy("block_reason")
        .agg(F.count(F.lit(1)).alias("blocked_count"))
    )
