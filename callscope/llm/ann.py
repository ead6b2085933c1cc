"""Nearest neighbours by inner product: multiprobe hashing with p-stable projections.

Vectors are dealt to bands of like norm, from the longest one down, and lifted by one component to their band's
largest norm, so that within a band the largest inner product is the smallest Euclidean distance.  Without bands one
long vector would press all others to a single pole, away from every query.  Each table hashes a vector to a cell of `WIDTH`-wide slots along `PROJECTIONS` random normal directions.
In every band a query visits its own cell and the cells next to it in the order of their estimated success, that is by
the squared distance to the slots' edges.  Members of visited cells are ranked by their exact product, and the
tables' lists are merged.

Equal vectors form a class: it is hashed once and keeps its `k + 1` smallest ids, which are all of its members
that can be among a query's first k.  Large cells are cut into blocks on both sides, so no task holds a cell whole.

Vectors that are null, zero, or hold a null or a non-finite component take no part, neither do rows without an id.
Vectors of different lengths are never compared.  Repeated rows count once.

`PROBES` of the cells near a query are visited per table and band.  A query that finds fewer than `k + 1` classes there
goes through all the others in a further round of the same block joins, so it gets all that its table has.  The given vectors spread evenly over the
sphere: a twentieth neighbour is at nine tenths of the distance of a random pair, so a recall of 0.9 takes
coarse cells and most of those around a query; data with closer neighbours do with more projections.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.words import FACTORS, U64, mix
from callscope.session import scratch_dir

TABLES = 4
PROJECTIONS = 4
WIDTH = 1.6
PROBES = 40
#: Largest norm of a band over its smallest; single precision has fewer than 700 such bands.
BAND = 1.5
NEIGHBOURS = 20
BLOCK = 2048
SEED = 11
_SLACK = 1e-9


def directions(table: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A table's normal directions and offsets, for vectors of this length."""
    random = np.random.default_rng([SEED, table, dim])
    return random.normal(size=(dim, PROJECTIONS)), random.uniform(0, WIDTH, PROJECTIONS)


def places(vectors: np.ndarray, table: int) -> np.ndarray:
    """Where vectors fall along a table's directions, in slots."""
    along, offset = directions(table, vectors.shape[1])
    return (vectors @ along + offset) / WIDTH


def cell_keys(cells: np.ndarray, table: int, dim: int, bands: np.ndarray) -> np.ndarray:
    """One key for each row of slot numbers and its band."""
    keys = (cells.astype(np.int64).view(U64) * FACTORS[: cells.shape[1]]).sum(axis=1, dtype=U64)
    return mix(keys + mix(mix(np.array([table * 1_000_003 + dim + 1], U64)) + bands.astype(U64))).view(np.int64)


def probe_order(inside: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The first perturbation sets (direction, step), cheapest first; the empty one leads.

    `inside` is the place within the own slot.  Sets grow by the two usual moves on the moves sorted by cost:
    replace the last one by the next, or add the next.
    """
    moves = sorted([(float(x * x), i, -1) for i, x in enumerate(inside)] + [(float((1 - x) ** 2), i, 1) for i, x in enumerate(inside)])
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(moves[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
        steps = [moves[j][1:] for j in chosen]
        if len({i for i, _ in steps}) == len(steps):
            out.append(steps)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield batch.take(pa.array(np.flatnonzero(sizes == size))) if len(np.unique(sizes)) > 1 else batch


_ROWS = "cell long, id long, vector array<float>"
_SLICE = 256


def _hash(radii: dict[int, float], probes: int):
    """Rows (cell, id, vector) of each vector (id, vector, band): its own cells, or those that a query visits."""

    def own(vectors: np.ndarray, bands: np.ndarray, table: int) -> np.ndarray:
        share = (vectors / np.array([radii[b] for b in bands.tolist()])[:, None]).reshape(vectors.shape)
        lifted = np.column_stack([share, np.sqrt(np.maximum(0.0, 1 - (share**2).sum(axis=1)))])
        return cell_keys(np.floor(places(lifted, table)), table, vectors.shape[1], bands)

    def near(vectors: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        at = places(np.column_stack([vectors / np.sqrt((vectors**2).sum(axis=1))[:, None], np.zeros(len(vectors))]), table)
        cells = np.floor(at)
        visited, rows = [], []
        for i, (cell, inside) in enumerate(zip(cells, at - cells, strict=True)):
            order = probe_order(inside, probes)
            around = np.repeat(cell[None, :], len(order), axis=0)
            for n, steps in enumerate(order):
                for direction, step in steps:
                    around[n, direction] += step
            visited.append(around)
            rows.append(np.full(len(order), i))
        return np.concatenate(visited), np.concatenate(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for alike in _by_length(whole):
                for batch in (alike.slice(start, _SLICE) for start in range(0, len(alike), _SLICE)):
                    vectors = _matrix(batch.column(1))
                    for table in range(TABLES):
                        if not probes:
                            keys = own(vectors, batch.column(2).to_numpy(), table)
                            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0), batch.column(1)], ["cell", "id", "vector"])
                            continue
                        visited, rows = near(vectors, table)
                        take = pa.array(rows)
                        ids, arrays = batch.column(0).take(take), batch.column(1).take(take)
                        for band in radii:
                            keys = cell_keys(visited, table, vectors.shape[1], np.full(len(visited), band))
                            yield pa.RecordBatch.from_arrays([pa.array(keys), ids, arrays], ["cell", "id", "vector"])

    return run


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores, ties to the smaller id."""
    if len(scores) > n:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:n]


def _rank_block(n: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["query"].to_numpy()
        ids, vectors = table["id"].to_numpy(), _matrix(table["vector"].chunk(0)) if table.num_rows else np.empty((0, 0))
        data, asked = np.flatnonzero(~side), np.flatnonzero(side)
        lists = []
        members, numbers = vectors[data], ids[data]
        rough = members @ vectors[asked].T
        for j, q in enumerate(asked):
            column = rough[:, j]
            if len(column) > n:
                some = np.flatnonzero(column >= np.partition(column, len(column) - n)[len(column) - n] - _SLACK)
            else:
                some = np.arange(len(column))
            exact = (members[some] * vectors[q]).sum(axis=1)
            at = best(exact, numbers[some], n)
            lists.append((ids[q], numbers[some][at], exact[at]))
        kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())
        return pa.table({name: pa.array([x[i] for x in lists], kind) for i, (name, kind) in enumerate(zip(("id", "near", "scores"), kinds, strict=True))})

    return run


def _merge(n: int):
    def run(table: pa.Table) -> pa.Table:
        near = table["near"].combine_chunks().flatten().to_numpy()
        scores = table["scores"].combine_chunks().flatten().to_numpy()
        near, first = np.unique(near, return_index=True)
        at = best(scores[first], near, n)
        return pa.table({"id": table["id"].slice(0, 1), "near": pa.array([near[at]], pa.list_(pa.int64())), "scores": pa.array([scores[first][at]], pa.list_(pa.float64()))})

    return run


def _store(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(frame.sparkSession, f"ann-{name}")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


_LISTS = "id long, near array<long>, scores array<double>"


def _blockwise(data: DataFrame, visits: DataFrame, n: int, name: str) -> DataFrame:
    """id, near, scores: a query's n best members of each block of the cells (cell, id, vector) that it visits."""
    parts = lambda frame, name: frame.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    # Stored before the joins, so that a cell with very many rows is split there.
    counts = _store(parts(data, "blocks").join(parts(visits, "query_blocks"), "cell"), name)
    spread = lambda frame, own, other, side: (
        frame.join(counts, "cell")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .select("cell", F.col("other" if side else "own").alias("block"), F.col("own" if side else "other").alias("query_block"), F.lit(side).alias("query"), "id", "vector")
    )
    return (
        spread(data, "blocks", "query_blocks", False)
        .union(spread(visits, "query_blocks", "blocks", True))
        .groupBy("cell", "block", "query_block")
        .applyInArrow(_rank_block(n), _LISTS)
    )


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS, vec_id: str = "vec_id", vector: str = "embedding", probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for every row that `is_query` (a column) names."""
    sound = F.col("vector").isNotNull() & F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vector"), is_query.alias("query")).where(sound)
    seats = Window.partitionBy("vector").orderBy("vec_id")
    classes = _store(
        rows.select("vector", "vec_id").withColumn("seat", F.dense_rank().over(seats)).where(F.col("seat") <= k + 1)
        .groupBy("vector").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_set("vec_id")).alias("members")),
        "classes",
    )
    asked = _store(
        rows.where("query").select("vec_id", "vector").distinct().join(classes.select("vector", "id"), "vector").select(F.col("vec_id").alias("query_id"), "id"), "asked"
    )
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    longest = classes.agg(F.max(length)).first()[0]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    band = F.floor(F.log(F.lit(longest) / F.col("length")) / (2 * math.log(BAND))).cast("int")
    banded = _store(classes.select("id", "vector", length.alias("length")).withColumn("band", band), "bands")
    radii = {r["band"]: math.sqrt(r["longest"]) for r in banded.groupBy("band").agg(F.max("length").alias("longest")).collect()}
    rows_of = banded.select("id", "vector", "band")
    data = _store(rows_of.mapInArrow(_hash(radii, 0), _ROWS), "cells")
    wanted = asked.select("id").distinct()
    visits = rows_of.join(wanted, "id", "left_semi").mapInArrow(_hash(radii, probes), _ROWS)
    visits = _store(visits.join(data.select("cell").distinct(), "cell", "left_semi"), "visits")
    merge = lambda found: found.groupBy("id").applyInArrow(_merge(k + 1), _LISTS)
    merged = _store(merge(_blockwise(data, visits, k + 1, "counts")), "merged")
    short = _store(wanted.join(merged.where(F.size("near") > k), "id", "left_anti"), "short")
    if not short.isEmpty():
        every = banded.select(F.size("vector").cast("long").alias("cell"), "id", "vector")
        more = _blockwise(every, every.join(short, "id", "left_semi"), k + 1, "more-counts")
        merged = merged.join(short, "id", "left_anti").union(merge(more))
    pairs = merged.select(F.col("id").alias("query_class"), F.explode(F.arrays_zip("near", "scores")).alias("x")).select("query_class", F.col("x.near").alias("id"), F.col("x.scores").alias("score"))
    lists = (
        pairs.join(classes.select("id", "members"), "id")
        .select("query_class", "score", F.explode("members").alias("vec_id"))
        .groupBy("query_class")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k + 1).alias("near"))
    )
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.join(lists, F.col("id") == F.col("query_class"))
        .select("query_id", F.posexplode(others).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))
    )
