"""MinHash near-duplicates: one-permutation hashing, optimal densification, star-shaped candidates.

1. Each text's set of 5-word shingles is hashed once per shingle into `BINS` bins; the smallest hash
   of a bin is its value, and an empty bin takes the value of a filled one that a fixed random walk
   reaches first.  `ROWS` bins make a band, a band's key names a bucket.
2. Texts with equal sets form a class, which its smallest id stands for; only those ids go on.
3. In each bucket every member is paired with one centre (a star), so a bucket of n members gives
   n - 1 candidates.  Candidates are confirmed on the full sets.
4. Buckets whose members are now in one component are done.  In the others every member outside the
   largest component is compared with all the rest, block by block inside the tasks, so no pair that
   shares a bucket is left out and no list of pairs is made.

A pair at the limit of 0.85 shares none of the 48 buckets with probability (1 - 0.85**8)**48 = 2e-7.
A set of fewer than six shingles can only be linked with an equal one, and needs no bands.

Null and empty texts have an empty set and are linked with nothing; rows without an id take no part
and get no component.  Repeated rows are returned once each with the same component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.batches import map_texts
from callscope.llm.scratch import Scratch
from callscope.llm.words import FACTORS, U64, Words, as_bytes, grams, mix, sized

WIDTH = 5
ROWS = 8
BANDS = 48
BINS = ROWS * BANDS
MIN_PERCENT = 85
BLOCK = 512
#: Shingles in a block and in a lane, at most about; a longer text is a block of its own.
BLOCK_SHINGLES = 500_000
LANE_SHINGLES = 1_000_000
_LEAST = MIN_PERCENT // (100 - MIN_PERCENT) + 1  # smaller sets have no near neighbour but their equals


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, letters A-Z in lower case."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    at, keys = grams(hashes, words.doc, WIDTH)
    edges = np.searchsorted(words.doc[at], np.arange(len(texts) + 1))
    out = []
    for i, n in enumerate(words.counts):
        if 0 < n < WIDTH:
            own = hashes[words.at[i] : words.at[i + 1]]
            out.append(mix(np.array([(own * FACTORS[8 : 8 + n]).sum(dtype=U64) + U64(n)], U64)))
        else:
            out.append(np.unique(keys[edges[i] : edges[i + 1]]))
    return out


_walks: list[np.ndarray] = []


def _walk(step: int) -> np.ndarray:
    """Where every bin looks in this step of its walk."""
    while len(_walks) <= step:
        seeds = np.arange(BINS, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix(np.array([len(_walks) + 1], U64))
        _walks.append((mix(seeds) % U64(BINS)).astype(np.int64))
    return _walks[step]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each band, from a sorted set of hashes."""
    bins = (((hashes >> U64(32)) * U64(BINS)) >> U64(32)).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    values = np.zeros(BINS, U64)
    has = np.zeros(BINS, bool)
    values[filled], has[filled] = hashes[first], True
    empty, step = np.flatnonzero(~has), 0
    while len(empty):
        at = _walk(step)[empty]
        hit = has[at]
        values[empty[hit]] = values[at[hit]]
        empty, step = empty[~hit], step + 1
    rows = values.reshape(BANDS, ROWS) * FACTORS[:ROWS]
    return mix(rows.sum(axis=1, dtype=U64) + mix(np.arange(BANDS, dtype=U64)))


_SIGNED = "doc_id long, n_shingles long, low long, high long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(1))
        for low, high in sized(texts):
            sets = shingle_sets(texts[low:high])
            two = [(mix(s).sum(dtype=U64), mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)) for s in sets]
            bands = [band_keys(s).view(np.int64) if len(s) >= _LEAST else np.empty(0, np.int64) for s in sets]
            columns = [batch.column(0).slice(low, high - low).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array(np.array([t[i] for t in two], U64).view(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "low", "high", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(1))
        for low, high in sized(texts):
            sets = pa.array([s.view(np.int64) for s in shingle_sets(texts[low:high])], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), sets], ["id", "hashes"])


def _min_labels(store: Scratch, links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over links (a, b), by large-star and small-star steps.

    Every step replaces edges by as many or fewer, and takes minima that combine before the shuffle.
    """
    edges = store.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: hang every larger neighbour on the smallest one.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.where("m < a").select("a", F.col("m").alias("b"))
        )
        large = large.distinct()
        # Small star: hang the node and its smaller neighbours on the smallest of them.
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, store.keep(small.union(roots.select("a", F.col("m").alias("b"))).distinct())
        store.drop(before)
        last, state = state, edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == last:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are near enough."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - both
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(F.least(F.size("x"), F.size("y")) * 100 >= F.greatest(F.size("x"), F.size("y")) * MIN_PERCENT)
        .where(both * 100 >= union * MIN_PERCENT)
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id (smallest id with an equal set) of each row."""
    store = Scratch(docs.sparkSession, "neardup")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = store.keep(map_texts(source, _sign, _SIGNED))
    # Stored before the join, so that a set with very many copies is split there.
    classes = store.keep(
        signed.where("doc_id is not null and n_shingles > 0").groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    )
    with_class = store.keep(
        signed.where("doc_id is not null and n_shingles > 0")
        .select("doc_id", "low", "high", "n_shingles")
        .join(classes, ["low", "high", "n_shingles"])
        .select("doc_id", "low", "high", "n_shingles", "class_id")
    )
    keys = (
        signed.where(F.size("bands") > 0)
        .join(with_class.where("doc_id = class_id").select("doc_id", "low", "high").distinct(), ["doc_id", "low", "high"], "left_semi")
        .select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    )
    shared = keys.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head <> tail")
    members = store.keep(keys.join(shared, "key").select("key", "id", "head").distinct())
    thin = store.keep(signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles"))
    store.drop(signed, classes)
    labels = _link(store, source, members)
    store.drop(members)
    rooted = with_class.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "doc_id", "n_shingles", "class_id", "low", "high", F.coalesce("root", "class_id").alias("component_id")
    )
    alone = thin.select(
        "doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")
    )
    return (
        rooted.select("doc_id", "n_shingles", "class_id", "component_id")
        .union(alone)
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
    )


def _link(store: Scratch, source: DataFrame, members: DataFrame) -> DataFrame:
    """(id, root) of every class that is linked with another one."""
    ids = members.select("id").distinct()
    texts = source.join(ids, source["doc_id"] == ids["id"], "left_semi").select(F.col("doc_id").alias("id"), "text")
    sets = store.keep(
        map_texts(texts, _sets, "id long, hashes array<long>")
        .distinct()
        .select("id", F.size("hashes").alias("size"), "hashes")
    )
    stars = members.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    links = store.keep(_confirm(stars, sets))
    labels = _min_labels(store, links)
    more = store.keep(_compare_rest(store, members, labels, sets))
    store.drop(sets)
    return labels if more.isEmpty() else _min_labels(store, links.union(more))


def _blocks(n, size):
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")


def _compare_rest(store: Scratch, members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the components that still share a bucket.

    In each bucket the members outside its largest component are held against all others, in cells
    of at most about `BLOCK` times `BLOCK` members, or fewer long ones, that are dealt out evenly.  A cell gives its
    links only, and those only as far as they join two components.
    """
    sizes = sets.select("id", "size")
    placed = store.keep(members.join(labels, "id", "left").join(sizes, "id").select("key", "id", "size", F.coalesce("root", "id").alias("root")))
    by_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "root", "size")).alias("most")
    # Stored before the join, so that a bucket with very many members is split there.
    mixed = store.keep(
        by_root.groupBy("key")
        .agg(most, F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("roots"))
        .where("roots > 1")
        .select(
            "key", F.col("most.root").alias("main"), _blocks(F.col("most.n"), F.col("most.size")).alias("n_main"),
            _blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("n_odd"),
        )
    )
    placed = placed.join(mixed, "key").withColumns({"odd": F.col("root") != F.col("main"), "h": F.xxhash64("id")})
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    odd = placed.where("odd").select("key", "id", "root", "n_main", "n_odd", F.pmod("h", "n_odd").cast("int").alias("own"))
    main = placed.where("not odd").select("key", "id", "root", "n_odd", F.pmod("h", "n_main").cast("int").alias("own"))
    cell = lambda kind, p, q, side: (F.struct("key", F.lit(kind).alias("kind"), p.alias("p"), q.alias("q")).alias("cell"), "id", "root", side.cast("int").alias("side"))
    own, other = F.col("own"), F.col("other")
    rows = (
        odd.select("key", "id", "root", "own", upto("n_main")).select(*cell(0, own, other, F.lit(0)))
        .union(main.select("key", "id", "root", "own", upto("n_odd")).select(*cell(0, other, own, F.lit(1))))
        .union(
            odd.select("key", "id", "root", "own", upto("n_odd")).select(
                *cell(1, F.least(own, other), F.greatest(own, other), F.when(own == other, 2).otherwise((own > other).cast("int")))
            )
        )
    )
    rows = store.keep(rows)
    shingles = rows.join(sizes, "id").agg(F.sum("size")).first()[0] or 0
    lanes = max(1, shingles // LANE_SHINGLES)
    return (
        rows.withColumn("lane", F.pmod(F.xxhash64("cell"), F.lit(lanes)))
        .join(sets, "id")
        .select("lane", "cell.*", "side", "id", "root", "hashes")
        .groupBy("lane")
        .applyInArrow(_compare_lane, "a long, b long")
    )


def _compare_lane(table: pa.Table) -> pa.Table:
    """The links of a lane's cells that join two components."""
    names = ("key", "kind", "p", "q")
    order = np.lexsort([table[n].to_numpy() for n in names])
    columns = [table[n].to_numpy()[order] for n in names]
    breaks = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    ids, roots, sides = (table[n].to_numpy()[order] for n in ("id", "root", "side"))
    hashes = table["hashes"].combine_chunks().take(pa.array(order))
    flat, at = hashes.flatten().to_numpy(), np.concatenate(([0], np.cumsum(hashes.value_lengths().to_numpy())))
    over: dict[int, int] = {}

    def top(x: int) -> int:
        while x in over:
            x = over[x]
        return x

    out: list[tuple[int, int]] = []
    for rows in np.split(np.arange(len(order)), breaks):
        left, right = rows[sides[rows] != 1], rows[sides[rows] != 0]
        if not len(left) or not len(right):
            continue
        sizes = at[right + 1] - at[right]
        there = np.concatenate([flat[at[r] : at[r + 1]] for r in right])
        owner = np.repeat(np.arange(len(right)), sizes)
        rank = np.argsort(there, kind="stable")
        there, owner = there[rank], owner[rank]
        for r in left:
            own = flat[at[r] : at[r + 1]]
            low, high = np.searchsorted(there, own, "left"), np.searchsorted(there, own, "right")
            n = high - low
            hits = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[hits], minlength=len(right))
            near = 100 * both >= MIN_PERCENT * (sizes + len(own) - both)
            for other in right[near & (roots[right] != roots[r])]:
                a, b = top(int(roots[r])), top(int(roots[other]))
                if a != b:
                    over[max(a, b)] = min(a, b)
                    out.append((int(ids[r]), int(ids[other])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
