"""Mixing sources to target weights.

Tokens are summed per source, targets share out a budget by weight under a cap per source, and each
document is emitted floor(rate) times plus once more with probability rate - floor(rate), decided by a
hash of seed and document id, so that reruns agree.

Null texts have size 0; a null source is a source of its own and comes last; documents with equal ids
(nulls included) share their draw; an empty table, or one without words, gets targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.session import scratch_dir

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Sources up to this number are broadcast, about a megabyte; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
_DRAW_DIGITS = 13


def words_in(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: str | Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed and id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, _DRAW_DIGITS), 16, 10).cast("double") / float(16**_DRAW_DIGITS)


def ranked(totals: DataFrame) -> DataFrame:
    """Sources with their place in code point order, nulls last, without a global window."""
    path = scratch_dir(totals.sparkSession, "mix-sources")
    placed = totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    placed.select("source", "source_size", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")).write.parquet(path)
    placed = totals.sparkSession.read.parquet(path)
    # One number per sort partition comes to the driver.
    before, rank = 0, F.lit(0).cast("long")
    for row in sorted(placed.groupBy("part").count().collect()):
        rank = F.when(F.col("part") == row["part"], F.col("at") + before).otherwise(rank)
        before += row["count"]
    return placed.select("source", "source_size", rank.alias("rank"))


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target of each source in `totals` (source, source_size)."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = ranked(totals).withColumn("weight", weight)
    level, capped = 0.0, -1
    ceiling = F.col("source_size") * F.lit(cap)
    full = F.lit(False)
    while True:
        got = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size"))).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if got["n"] == capped or not got["open"]:
            break
        capped = got["n"]
        level = (share * got["all"] - cap * (got["held"] or 0)) / got["open"]
        full = ceiling < F.col("weight") * F.lit(level)
    return sources.select("source", "source_size", F.when(full, ceiling).otherwise(F.col("weight") * F.lit(level)).cast("double").alias("target"))


def mix(docs: DataFrame, sized: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with source_size, target, rate and copies; `sized` holds source and size of every document."""
    spark = docs.sparkSession
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    path = scratch_dir(spark, "mix-targets")
    targets(totals).write.parquet(path)
    goals = spark.read.parquet(path).withColumnRenamed("source", "_source")
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        docs.drop("source_size", "target", "rate", "copies")
        .join(goals, F.col(source).eqNullSafe(F.col("_source")), "left")
        .drop("_source")
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + (draw(doc_id) < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
    )


def sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Id, source and size of every document, stored once."""
    path = scratch_dir(docs.sparkSession, "mix-sizes")
    docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(text).alias("size")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as many times as it is taken."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).drop("_copy")
