"""Percentiles: exact ones through histograms, approximate ones through mergeable sketches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.timing import hour_bucket

# Width of a histogram bucket.  An int has at most 65 536 buckets of 65 536 values each.
_BUCKET_BITS = 16
#: The measure by which arrivals are counted.
ARRIVAL = "arrival"


def _bucket() -> Column:
    return F.coalesce(F.shiftright("v", _BUCKET_BITS), F.lit(0).cast("long"))


def value_histogram(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Rows per distinct whole value of every group: groups, v, n.

    Counts combine before they move.  Rows without a value or a group are left out and the bucket
    column `b` is never null, so that consumers' joins add no filter of their own and all of them
    read one shuffled histogram.
    """
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (value, *groups)])
    return (
        df.where(present)
        .groupBy(*groups, F.col(value).cast("long").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("b", _bucket())
    )


def histogram_percentiles(
    hist: DataFrame, fractions: Sequence[float], groups: Sequence[str]
) -> DataFrame:
    """Interpolated percentiles of a histogram: one row per group and fraction.

    A coarse histogram finds the bucket holding each wanted rank and only that bucket's values
    are walked; so however many rows a group has, a task sees at most one histogram row per
    bucket, or per value of one bucket.
    Output: groups, fraction, value (double), n.
    """
    groups = list(groups)
    in_order = Window.partitionBy(*groups).orderBy("b")
    coarse = (
        hist.groupBy(*groups, "b")
        .agg(F.sum("n").alias("_bn"))
        .withColumn("_upto", F.sum("_bn").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*groups)))
        .withColumn("_before", F.col("_upto") - F.col("_bn"))
    )
    rank = F.col("fraction") * (F.col("_total") - 1)
    wanted = (
        coarse.withColumn(
            "fraction", F.explode(F.array(*[F.lit(float(p)) for p in fractions]))
        )
        .withColumn("_lo", F.floor(rank).cast("long"))
        .withColumn("_hi", F.ceil(rank).cast("long"))
        .withColumn("_rest", rank - F.floor(rank))
        .where(
            F.col("_lo").between(F.col("_before"), F.col("_upto") - 1)
            | F.col("_hi").between(F.col("_before"), F.col("_upto") - 1)
        )
        .select(*groups, "b", "fraction", "_lo", "_hi", "_rest", "_before", "_total")
    )
    walk = (
        Window.partitionBy(*groups, "fraction", "b")
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    walked = hist.join(wanted, [*groups, "b"]).withColumn(
        "_seen", F.col("_before") + F.sum("n").over(walk)
    )
    low = F.min(F.when(F.col("_seen") > F.col("_lo"), F.col("v")))
    high = F.min(F.when(F.col("_seen") > F.col("_hi"), F.col("v")))
    return walked.groupBy(*groups, "fraction").agg(
        (low + (high - low) * F.max("_rest")).alias("value"),
        F.max("_total").alias("n"),
    )


def exact_percentiles(
    df: DataFrame, value: str, fractions: Sequence[float], groups: Sequence[str]
) -> DataFrame:
    """Exact interpolated percentiles of a whole-number column per (non-null) group."""
    return histogram_percentiles(value_histogram(df, value, groups), fractions, groups)


def _sampled() -> Column:
    return (F.col("status") == "success") & F.col("duration_ms").isNotNull()


#: Whole-number columns of the percentile report; output rates in hundredths.
_MEASURES = {"dur": "duration_ms", "ttft": "ttft_ms", "rate": "tokens_per_second * 100"}


def measured(logs: DataFrame) -> DataFrame:
    """What the percentile report counts of successful calls with a duration: measure (`dur`, `ttft`, `rate`), x."""
    cells = [F.struct(F.lit(name).alias("measure"), F.expr(value).cast("long").alias("x")) for name, value in _MEASURES.items()]
    return logs.where(_sampled()).select(F.explode(F.array(*cells)).alias("m")).select("m.measure", "m.x")


def hourly_values(logs: DataFrame, *keep: str) -> DataFrame:
    """Mergeable exact histograms per hour of arrival: `keep`, arrival_hour, measure, v, n.

    Besides the report's measures every row counts as one `ARRIVAL`, whose value is 0.
    """
    cells = [F.struct(F.lit(ARRIVAL).alias("measure"), F.lit(0).cast("long").alias("x"))]
    for name, value in _MEASURES.items():
        cells.append(F.struct(F.lit(name).alias("measure"), F.when(_sampled(), F.expr(value).cast("long")).alias("x")))
    hour = hour_bucket(F.col("created_at")).alias("arrival_hour")
    stacked = logs.select(*keep, hour, F.explode(F.array(*cells)).alias("m")).select(*keep, "arrival_hour", "m.measure", "m.x")
    return value_histogram(stacked, "x", [*keep, "arrival_hour", "measure"]).drop("b")


def merge_values(shares: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add histograms up over a coarser group: groups, v, n, b."""
    return shares.groupBy(*groups, "v").agg(F.sum("n").alias("n")).withColumn("b", _bucket())


def latency_sketches(logs: DataFrame, keys: Sequence[str], k: int = 200) -> DataFrame:
    """One mergeable quantile sketch of the latency per key: a few KB whatever the row count."""
    return (
        logs.where((F.col("status") == "success") & F.col("duration_ms").isNotNull())
        .groupBy(*keys)
        .agg(
            F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), F.lit(k)).alias("sketch"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine stored sketches over a coarser key (hours into days, models into providers)."""
    return sketches.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n")
    )


def sketch_quantiles(sketches: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Read quantiles out of sketches: `{"p95": 0.95}` adds a column p95."""
    reads = [
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name)
        for name, p in fractions.items()
    ]
    return sketches.select("*", *reads).drop("sketch")
