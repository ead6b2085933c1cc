"""Per-key ordering that survives a hot key.

A plain window partitions by key, which puts a hot key's rows into one task.  The helpers here
keep every task's share bounded: they rank on thin rows with a salt, or cut a key's sequence
into segments and hand each segment the few earlier rows it looks back on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.session import scratch_dir

SALTS = 64
#: Copies of a look-up row in `spread_join`, at most: a hot key's rows go to that many places.
SPREAD = 32
#: `isolated_join` takes a key as heavy from this part of all rows on, so there are no more heavy keys than this.
HEAVY_SHARE = 1000
SEGMENT_ROWS = 100_000
_PLACE = [T.StructField("_row", T.LongType()), T.StructField("_task", T.LongType())]


def nth_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    descending: bool = False,
    name: str = "cutoff",
) -> DataFrame:
    """The n-th row's order columns (as a struct) for every key that has at least n rows.

    `row_number <= n` lets Spark drop rows above the limit before each shuffle; the salt keeps
    the first ranking spread, so the second sees at most SALTS * n rows of a key.
    """
    keys = list(keys)
    thin = df.select(*keys, F.struct(*order).alias(name))
    salted = thin.withColumn("_salt", F.pmod(F.xxhash64(name), F.lit(SALTS)))
    by = F.col(name).desc() if descending else F.col(name).asc()
    first = Window.partitionBy(*keys, "_salt").orderBy(by)
    final = Window.partitionBy(*keys).orderBy(by)
    heads = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n)
    return (
        heads.withColumn("_rn", F.row_number().over(final))
        .where(F.col("_rn") == n)
        .select(*keys, name)
    )


def spread_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], by: Sequence[str], copies: int = SPREAD, how: str = "left") -> DataFrame:
    """Join with a thin look-up in which a key has one row, a key's rows spread over `copies` places.

    A look-up that ends in a window or a grouping by the key is dealt out already, and the adaptive skew join
    can't split what meets it.  Here its rows are copied for every place, and the columns `by` choose a row's
    place.  For look-ups that have far fewer keys than there are rows.
    """
    placed = rows.withColumn("_place", F.pmod(F.xxhash64(*by), F.lit(copies)).cast("int"))
    copied = lookup.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return placed.join(copied, [*keys, "_place"], how).drop("_place")


def isolated_join(rows: DataFrame, lookup: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Left join with a look-up in which a key has one row at most, heavy keys apart from the others.

    Keys with more than one in `HEAVY_SHARE` of all rows are counted first; there are at most that many, so their
    look-up rows are broadcast.  Their rows, and those without a key, get a key of their own in the
    shuffle with the rest of the look-up, so no key's rows meet in one task, whatever the look-up's size.
    """
    named = rows.where(F.col(key).isNotNull())
    total = rows.agg(F.count(F.lit(1))).scalar()
    heavy = named.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HEAVY_SHARE > total).select(key)
    values = [c for c in lookup.columns if c != key]
    found = F.struct(*[F.col(c) for c in values])
    top = heavy.join(lookup.select(key, found.alias("_found")), key, "left").select(F.col(key).alias("_heavy"), F.col("_found").alias("_heavy_found"))
    marked = rows.join(F.broadcast(top), F.col(key) == F.col("_heavy"), "left")
    alone = F.col(key).isNull() | F.col("_heavy").isNotNull()
    own = F.struct(alone.alias("alone"), F.when(~alone, F.col(key)).alias("key"), F.when(alone, F.xxhash64(*by)).alias("place"))
    rest = lookup.select(F.struct(F.lit(False).alias("alone"), F.col(key).alias("key"), F.lit(None).cast("long").alias("place")).alias("_key"), found.alias("_found"))
    joined = marked.withColumn("_own", own).join(rest, F.col("_own").eqNullSafe(F.col("_key")), "left")
    got = F.coalesce("_found", "_heavy_found")
    return joined.select(*rows.columns, *[got.getField(c).alias(c) for c in values])


def last_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n latest rows of every key, found through a per-key cutoff instead of a full sort.

    Only keys with at least n rows have a cutoff.  Full rows are never ranked, and a hot
    key's rows are spread over many places where they meet its cutoff.
    """
    keys = list(keys)
    cutoffs = nth_in_order(df, keys, order, n, descending=True, name="_cutoff")
    kept = spread_join(df, cutoffs, keys, order, max(2, min(SPREAD, n)))
    late_enough = F.col("_cutoff").isNull() | (F.struct(*order) >= F.col("_cutoff"))
    return kept.where(late_enough).drop("_cutoff")


def with_lookback(
    df: DataFrame, key: str, seq: str, n: int, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Cut each key's sequence into segments and copy in the n rows before each segment.

    `seq` is an integer, unique within its key, so a segment holds at most `segment_rows` own
    rows.  Adds `_segment` and `_carried`; a window over (key, _segment) that looks back at most
    n rows is then exact on the rows where `_carried` is false.  Gaps in `seq` are allowed.
    Keys that fit one segment cost no copies.
    """
    own = df.withColumn("_segment", F.floor(F.col(seq) / F.lit(segment_rows)).cast("long"))
    long_keys = (
        own.groupBy(key)
        .agg(F.min("_segment").alias("_lo"), F.max("_segment").alias("_hi"))
        .where(F.col("_hi") > F.col("_lo"))
        .select(key)
    )
    newest = Window.partitionBy(key, "_segment").orderBy(F.col(seq).desc())
    tails = (
        spread_join(own, long_keys, [key], [key, seq], how="left_semi")
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= n)
        .drop("_rn")
    )
    ahead = Window.partitionBy(key).orderBy(seq).rowsBetween(1, n)
    reached = F.array_distinct(F.collect_list("_segment").over(ahead))
    carried = (
        tails.withColumn("_to", reached)
        .withColumn("_to", F.explode(F.filter("_to", lambda s: s != F.col("_segment"))))
        .withColumn("_segment", F.col("_to"))
        .drop("_to")
        .withColumn("_carried", F.lit(True))
    )
    return own.withColumn("_carried", F.lit(False)).unionByName(carried)


def lookback_window(key: str, seq: str, n: int):
    """The frame to use on `with_lookback` output: n earlier rows and the current one."""
    return Window.partitionBy(key, "_segment").orderBy(seq).rowsBetween(-n, 0)


def position_in_key(df: DataFrame, key: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Dense 0-based position of every row in its key, in the order of the columns `order`; rows without a key are a key.

    Rows are dealt out by sampled ranges of (key, order), so a hot key takes as many tasks as its rows need, however
    close in time they are.  Each task numbers its sorted rows; a key's first number and count in every
    task, at most one row for each task, then give the rows that lie before.  The numbered rows are
    stored in between, as ranges drawn again would differ.  Rows that agree in key and order get positions in any order.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "positions")
    dealt = df.repartitionByRange(F.col(key), *[F.col(c) for c in order]).sortWithinPartitions(key, *order)
    # The upper bits of such an id are the task, the lower ones the row in it.
    dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_row", 33)).write.parquet(path)
    stored = spark.read.schema(T.StructType([*df.schema.fields, *_PLACE])).parquet(path)
    shares = stored.groupBy(F.col(key).alias("_key"), F.col("_task").alias("_in")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    shifts = shares.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    met = stored.join(shifts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_task") == F.col("_in")))
    return met.select(*df.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias(name))
