"""Product codes of vectors: every part of a vector becomes the number of its codebook's nearest entry.

Nearest entries are found by slices and intersections.  For each dimension a codebook's entries are sorted by their
coordinate, and prefix masks tell which entries lie among the first k.  A radius around a part cuts a range out of every
dimension's order; the difference of two prefix masks is the range's entries, and the AND over all dimensions
is the box around the part.  The radius is the distance to some entry, so the box holds every entry that is as
near or nearer, and the exact distances of the box's entries decide.

Components x become floor(4096 * x).  Codebooks start as the parts of the smallest ids' vectors, and a round replaces every
entry by the floor of its parts' mean.  Tasks add up their parts per entry; codebooks are all that the driver holds.

Vectors that are null or hold a null or non-finite component take no part; of vectors of unequal lengths only
those of the commonest length do.  A length that the parts don't divide is filled up with zeros.  Where an id is
there more than once, the start takes its smallest vector; ids may be null, but don't start a codebook then.  Repeated
rows are coded once each.  Fewer ids than entries give smaller codebooks, an empty table gives no rows; if no row has an id,
nothing starts a codebook and there are no rows either.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.exact import decimals, fitting, floors, matrix, slices
from callscope.session import scratch_dir

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
_WORD = 64
_ROOTS = np.frompyfunc(math.isqrt, 1, 1)


class Codebook:
    """Entries of one part with their sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        m, d = entries.shape
        words = -(-m // _WORD)
        order = np.argsort(entries, axis=0, kind="stable")
        self.order = order
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.zeros((m, words), np.uint64)
        bits[np.arange(m), np.arange(m) // _WORD] = np.uint64(1) << (np.arange(m) % _WORD).astype(np.uint64)
        self.masks = np.zeros((d, m + 1, words), np.uint64)
        for k in range(d):
            self.masks[k, 1:] = np.bitwise_or.accumulate(bits[order[:, k]], axis=0)
        #: The dimension whose coordinates are spread widest proposes the entry that gives the radius.
        self.guide = int(np.argmax((self.sorted[-1] - self.sorted[0]).astype(np.float64)))

    def box(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries no dimension of which is farther away than the radius."""
        out = np.full((len(parts), self.masks.shape[2]), ~np.uint64(0))
        for k in range(parts.shape[1]):
            low = np.searchsorted(self.sorted[:, k], parts[:, k] - radius, "left")
            high = np.searchsorted(self.sorted[:, k], parts[:, k] + radius, "right")
            out &= self.masks[k][high] ^ self.masks[k][low]
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each part's nearest entry, ties to the lower number."""
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        m = len(self.entries)
        place = np.clip(np.searchsorted(self.sorted[:, self.guide], parts[:, self.guide]), 0, m - 1)
        gap = parts - self.entries[self.order[place, self.guide]]
        square = (gap * gap).sum(axis=1)
        radius = _ROOTS(square) + 1 if square.dtype == object else np.sqrt(square.astype(np.float64)).astype(np.int64) + 1
        mask = self.box(parts, radius)
        number = np.arange(m)
        hits = (mask[:, number // _WORD] >> (number % _WORD).astype(np.uint64)) & np.uint64(1)
        row, entry = np.nonzero(hits)
        gap = parts[row] - self.entries[entry]
        square = (gap * gap).sum(axis=1)
        best = np.minimum.reduceat(square, np.searchsorted(row, np.arange(len(parts))))
        found = np.flatnonzero(square == best[row])
        _, first = np.unique(row[found], return_index=True)
        return entry[found[first]], best


def cut(values: np.ndarray, parts: int) -> np.ndarray:
    """Rows as (row, part, place), filled up with zeros."""
    width = -(-values.shape[1] // parts)
    full = np.zeros((len(values), parts * width), values.dtype)
    full[:, : values.shape[1]] = values
    return full.reshape(len(values), parts, width)


def _parts(column: pa.Array, books: list[np.ndarray], scale: int) -> np.ndarray:
    """A batch's parts, as numbers wide enough for their distances to the codebooks."""
    values = cut(floors(matrix(column), scale), len(books))
    if values.dtype == object or not values.size:
        return values
    top = max(abs(int(x)) for a in (values, *books) for x in (a.max(), a.min()))
    return values.astype(object) if 4 * top * top * values.shape[2] >= 1 << 62 else values


def _assign(books: list[np.ndarray], scale: int):
    """Sums and counts per part and entry: (part, entry, place or -1 for the count, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in slices(batches):
            parts = _parts(batch.column(0), books, scale)
            for p, book in enumerate(found):
                entry, _ = book.nearest(parts[:, p])
                for e in np.unique(entry):
                    mine = parts[entry == e, p]
                    add = np.append(mine.sum(axis=0).astype(object), len(mine))
                    totals[p, int(e)] = totals.get((p, int(e)), 0) + add
        rows = [(p, e, at if at < len(t) - 1 else -1, x) for (p, e), t in totals.items() for at, x in enumerate(t)]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), decimals(columns[3])], ["part", "entry", "place", "total"])

    return run


def _code(books: list[np.ndarray], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        for batch in slices(batches):
            parts = _parts(batch.column(2), books, scale)
            each = [book.nearest(parts[:, p]) for p, book in enumerate(found)]
            codes = np.stack([e for e, _ in each], axis=1)
            error = sum(d.astype(object) for _, d in each)
            text = ["".join(f"{x:02x}" for x in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), decimals(error)], ["vec_id", "label", "code", "error"])

    return run


def start(rows: DataFrame, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The first codebooks: the parts of the smallest ids' vectors, in the order of the ids."""
    ids = [r["vec_id"] for r in rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return []
    first = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()
    values = cut(floors(np.array([r["vector"] for r in first], np.float64).reshape(len(first), -1), scale), parts)
    return [values[:, p] for p in range(parts)]


def renewed(rows: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """Codebooks after one more round; entries that no part is nearest to stay."""
    totals: dict[tuple[int, int], dict[int, int]] = {}
    sums = rows.select("vector").mapInArrow(_assign(books, scale), "part int, entry int, place int, total decimal(38,0)")
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
        totals.setdefault((r["part"], r["entry"]), {})[r["place"]] = int(r["total"])
    out = [b.astype(object) for b in books]
    for (p, e), found in totals.items():
        for place in range(out[p].shape[1]):
            out[p][e, place] = found[place] // found[-1]
    return [b.astype(np.int64) if all(abs(x) < 1 << 50 for x in b.ravel()) else b for b in out]


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in the order of part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


OUT = "vec_id long, label {}, code string, error decimal(38,0), label_error decimal(38,0), codebooks_sha256 string"


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each row."""
    spark = vectors.sparkSession
    kind = vectors.schema[label].dataType.simpleString()
    plain = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows, _ = fitting(plain, "vector")
    books = start(rows, parts, entries, scale)
    if not books:
        return spark.createDataFrame([], OUT.format(kind))
    for _ in range(rounds):
        books = renewed(rows, books, scale)
    path = scratch_dir(spark, "codes")
    rows.mapInArrow(_code(books, scale), f"vec_id long, label {kind}, code string, error decimal(38,0)").write.parquet(f"{path}/rows")
    coded = spark.read.parquet(f"{path}/rows")
    # Stored before the join, so that a label with very many rows is split there.
    coded.groupBy("label").agg(F.sum("error").alias("label_error")).write.parquet(f"{path}/labels")
    sums = spark.read.parquet(f"{path}/labels").withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
