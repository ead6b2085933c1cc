from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from helpers import empty_documents, odd_documents, prose

from callscope.llm import neardup
from callscope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_sets(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: brute_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op8_minhash_neardup"](spark, sf).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("size", [neardup.BLOCK, 7])
def test_chains_and_large_buckets(spark, monkeypatch, size):
    """Variants that are linked through others only, in buckets that a star leaves unfinished."""
    monkeypatch.setattr(neardup, "BLOCK", size)
    monkeypatch.setattr(neardup, "LANE_SHINGLES", 5000)
    rng = np.random.default_rng(3)
    base = prose(5, 120).split()
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(len(words), rng.integers(0, 5), replace=False):
            words[at] = f"z{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(i, prose(i, 50)) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 1, 1] and not by[4]["kept"]
    assert all(by[i]["component_id"] == i and by[i]["n_shingles"] == 0 for i in (5, 6, 7))
    assert by[9]["component_id"] == 8 and by[8]["n_shingles"] == 1
    assert by[None]["component_id"] is None
    assert neardup.near_duplicates(empty_documents(spark)).count() == 0


def test_densification_fills_every_bin():
    for n in (1, 6, 40, 5000):
        hashes = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        assert len(neardup.band_keys(hashes)) == neardup.BANDS
