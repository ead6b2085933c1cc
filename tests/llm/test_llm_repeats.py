"""Repeated passages against a count of all windows, and the suffix automaton by itself."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from helpers import empty_documents, odd_documents, prose

from callscope.llm import repeats
from callscope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window=35):
    """(n_words, removed places) of each text."""
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def check(frame):
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.without_repeats(frame).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True))


def test_query_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], *x) for r, x in zip(rows, brute([r["text"] for r in rows]), strict=True)}
    got = {tuple(r) for r in QUERIES["op13_repeated_passages"](spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == want and any(x[2] for x in want)


def shared_passages(n=60):
    """Passages of 34 to 90 words within different texts, at their ends, twice in one text, and overlapping copies of each other."""
    rng = np.random.default_rng(8)
    passages = [prose(100 + i, k).split() for i, k in enumerate((34, 35, 36, 50, 90))]
    rows = []
    for i in range(n):
        words = prose(1000 + i, int(rng.integers(0, 120))).split()
        for _ in range(int(rng.integers(0, 3))):
            passage = passages[int(rng.integers(len(passages)))]
            low = int(rng.integers(0, 10)) if rng.random() < 0.5 else 0
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = passage[low:]
        rows.append((i, " ".join(words)))
    few = "la la la la lo " * 40  # periods: windows that start again within their own text
    return [*rows, (n, few), (n + 1, "x " * 34), (n + 2, "y " * 35), (n + 3, "z " * 36), (n + 4, passages[3][0] + " " + " ".join(passages[3][1:]))]


@pytest.mark.parametrize(("variants", "words"), [(repeats.VARIANTS, repeats.SHARD_WORDS), (2, 500), (1, 500)])
def test_shared_passages(spark, monkeypatch, variants, words):
    """Also with anchors that are decided by their windows, and with many shards."""
    monkeypatch.setattr(repeats, "VARIANTS", variants)
    monkeypatch.setattr(repeats, "SHARD_WORDS", words)
    check(spark.createDataFrame(shared_passages(), "doc_id long, text string").repartition(4))


def test_odd_rows(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing names, and no rows at all."""
    check(odd_documents(spark))
    more = [(None, prose(7, 50)), (None, prose(7, 50)), (3, prose(8, 70)), (3, prose(8, 70)), (3, prose(9, 70)), (4, "  " + prose(9, 70)), (None, prose(10, 40)), (0, prose(10, 40) + " end")]
    check(spark.createDataFrame(more, "doc_id long, text string"))
    assert repeats.without_repeats(empty_documents(spark)).count() == 0


def test_spans_are_those_of_the_removed_words(spark):
    same = prose(5, 40)
    rows = [(1, prose(1, 20) + " " + same + " " + prose(2, 20)), (2, same + " " + prose(3, 20)), (3, prose(4, 90)), (4, prose(6, 50)), (5, prose(6, 50))]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(20, 60)], 2: [(0, 40)], 3: [], 4: [(0, 50)], 5: [(0, 50)]}


@pytest.mark.parametrize("alphabet", [2, 5])
def test_automaton_counts_runs(alphabet):
    """Spans of windows that end twice or more, against a count of all windows."""
    rng = np.random.default_rng(alphabet)
    for _ in range(40):
        passages = [rng.integers(0, alphabet, int(rng.integers(1, 40))).tolist() for _ in range(4)]
        times = rng.integers(1, 3, 4).tolist()
        automaton = repeats.SuffixAutomaton()
        for p, n in zip(passages, times, strict=True):
            automaton.add(p, n)
        automaton.close()
        for window in (1, 3, 6):
            seen = Counter()
            for p, n in zip(passages, times, strict=True):
                for i in range(len(p) - window + 1):
                    seen[tuple(p[i : i + window])] += n
            for p in passages:
                want = {j for i in range(len(p) - window + 1) if seen[tuple(p[i : i + window])] > 1 for j in range(i, i + window)}
                spans = automaton.spans(p, window)
                assert {j for a, b in spans for j in range(a, b)} == want
                assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
