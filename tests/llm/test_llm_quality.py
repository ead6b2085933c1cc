from __future__ import annotations

import re
from collections import Counter

import numpy as np
from helpers import LONG, empty_documents, odd_documents

from callscope.llm import quality
from callscope.llm.queries import QUERIES
from callscope.llm.words import Words, as_bytes, span_hashes  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "base_failed": n < 10 or 100 * len(covered) > 20 * n,
    }


def test_base_rules_match_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_quality_rules"](spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = brute_base(texts[row["doc_id"]])
        assert {k: row[k] for k in want} == want
        assert not (row["base_failed"] and row["kept"])


def test_score_matches_a_plain_count(spark):
    docs = [f"good words here {i} good text and more of it all" for i in range(30)] + [f"JUNK!! {i} ## buy now ## now" for i in range(30)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    weights = quality.log_ratios(frame, trusted)

    def keys(text):
        return quality.buckets(Words([text.encode()]))[1]

    raw, target = np.zeros(1 << quality.BUCKET_BITS), np.zeros(1 << quality.BUCKET_BITS)
    for i, text in enumerate(docs):
        for k in keys(text):
            raw[k] += 1
            target[k] += i < 20
    assert np.allclose(weights, quality.ratios(raw, target))
    got = {r["doc_id"]: r["score"] for r in quality.quality_rules(frame, trusted).collect()}
    assert all(abs(got[i] - weights[keys(t)].mean()) < 1e-9 for i, t in enumerate(docs))
    assert min(got[i] for i in range(30)) > max(got[i] for i in range(30, 60))


def test_verdict_agrees_with_held_out_labels(spark):
    """Fitted on two thirds of the good labels, judged on the rest and on the bad ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    trusted = labels.where("quality = 1 and doc_id % 3 <> 0").select("doc_id")
    rows = quality.quality_rules(docs, trusted).join(labels, "doc_id").collect()
    good = [r["kept"] or r["base_failed"] for r in rows if r["quality"] == 1 and r["doc_id"] % 3 == 0]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) >= 0.98
    assert sum(bad) / len(bad) <= 0.15


def test_odd_rows(spark):
    trusted = spark.createDataFrame([(1,), (1,), (None,), (999,)], "doc_id long")
    docs = odd_documents(spark)
    rows = quality.quality_rules(docs, trusted).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["n_words"] == by[6]["n_words"] == by[7]["n_words"] == 0 and by[5]["base_failed"] and not by[7]["kept"]
    assert by[10]["n_words"] == 60_000 and by[10]["word_chars"] == len(LONG) - 59_999
    assert by[12]["n_dup_lines"] == 1 and by[12]["n_symbols"] == 6
    assert quality.quality_rules(empty_documents(spark), trusted).count() == 0
    assert quality.quality_rules(docs, trusted.limit(0)).count() == docs.count()


def test_a_hash_does_not_depend_on_the_place():
    data = np.frombuffer(b"abc " * 700_000 + b"abc", np.uint8)
    words = Words([data.tobytes()])
    assert len(set(words.hashes().tolist())) == 1
