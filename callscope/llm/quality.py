"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Both sides are multinomials over hash buckets of word unigrams and bigrams.  The raw counts cover
every document; the target counts cover the trusted documents, of which at most `TRUSTED_MAX` are
taken, those with the smallest hash of their id.  A document's score is the mean of
log(p_target / p_raw) over its n-grams, and it is kept if that reaches a fixed threshold.

Null texts count as empty.  Documents without words fail the base rules.  Repeated rows are scored
and returned once each; a null id is never trusted.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.batches import map_texts
from callscope.llm.counts import SCHEMA, in_parts, summed
from callscope.llm.words import U64, Words, as_bytes, grams, mix, sized, span_hashes

BUCKET_BITS = 16
TRUSTED_MAX = 20_000
#: Counts added to each bucket, as a share of the bucket's raw probability times this many n-grams.
PRIOR = 200_000.0
THRESHOLD = -0.15
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

RULES_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash bucket of every unigram and bigram."""
    hashes = words.hashes()
    at, pairs = grams(hashes, words.doc, 2)
    shift = U64(64 - BUCKET_BITS)
    keys = np.concatenate((mix(hashes ^ U64(0x5851F42D4C957F2D)), pairs)) >> shift
    return np.concatenate((words.doc, words.doc[at])), keys.astype(np.int64)


def base_features(words: Words) -> dict[str, np.ndarray]:
    """The counts of the base rules, for each text."""
    data, doc, n = words.data, words.doc, len(words.lengths)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    per_word = chars[words.ends] - chars[words.starts]
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))

    ends = np.flatnonzero(data == 0x0A)
    starts = np.concatenate(([0], ends[:-1] + 1))
    worded = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    starts, ends = starts[worded], ends[worded]
    of = np.searchsorted(words.first, starts, "right") - 1
    keys = mix(span_hashes(data, starts, ends) + mix(of.astype(U64)))
    _, first = np.unique(keys, return_index=True)

    at, keys = grams(words.hashes(), doc, 5)
    keys = mix(keys + mix(doc[at].astype(U64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    steps = np.zeros(len(doc) + 1, np.int64)
    steps[at[found]] += 1
    np.subtract.at(steps, at[found] + 5, 1)
    covered = np.cumsum(steps)[:-1] > 0

    total = lambda x: np.bincount(doc, weights=x, minlength=n).astype(np.int64)
    return {
        "n_words": words.counts,
        "word_chars": total(per_word),
        "n_symbols": symbols[words.first[1:]] - symbols[words.first[:-1]],
        "n_dup_lines": np.bincount(of, minlength=n) - np.bincount(of[first], minlength=n),
        "n_repeat_words": total(covered),
    }


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a task's texts: [raw, target] in a fixed number of rows."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        texts, trusted = as_bytes(batch.column(0)), np.array(batch.column(1).to_pylist(), bool)
        for low, high in sized(texts):
            doc, keys = buckets(Words(texts[low:high]))
            counts[0] += np.bincount(keys, minlength=counts.shape[1])
            counts[1] += np.bincount(keys[trusted[low:high][doc]], minlength=counts.shape[1])
    if counts[0].any():
        yield in_parts(counts)


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """log(p_target / p_raw) of every bucket; `trusted` has one id per row.

    What comes to the driver is one number per bucket, 2**BUCKET_BITS in all.
    """
    ids = trusted.where(F.col(doc_id).isNotNull()).select(doc_id).distinct()
    ids = ids.orderBy(F.xxhash64(doc_id), doc_id).limit(TRUSTED_MAX)
    marked = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id")).join(
        F.broadcast(ids.select(F.col(doc_id).alias("id"), F.lit(True).alias("trusted"))), "id", "left"
    )
    parts = map_texts(marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")), _count, SCHEMA)
    return ratios(*summed(parts, 2, 1 << BUCKET_BITS).astype(float))


def ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log ratios: the target backs off to the raw distribution."""
    p = (raw + 0.5) / (raw + 0.5).sum()
    q = (target + PRIOR * p) / (target.sum() + PRIOR)
    return np.log(q) - np.log(p)


def score_texts(texts: list[bytes], weights: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """Base features, score and verdict of each text."""
    words = Words(texts)
    out = base_features(words)
    doc, keys = buckets(words)
    n = len(texts)
    sums = np.bincount(doc, weights=weights[keys], minlength=n)
    size = np.bincount(doc, minlength=n)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["score"] = np.where(size > 0, sums / np.maximum(size, 1), 0.0)
    out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
    return out


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: tuple[str, ...] = ("doc_id",),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The columns `keep` of every document with its features, score and verdict."""
    spark: SparkSession = docs.sparkSession
    weights = spark.sparkContext.broadcast(log_ratios(docs, trusted, text, doc_id))
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [RULES_SCHEMA])
    names = [c.split()[0] for c in RULES_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for low, high in sized(texts):
                got = score_texts(texts[low:high], weights.value, threshold)
                kept = [batch.column(i + 1).slice(low, high - low) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(got[name]) for name in names)], [*(f.name for f in fields), *names]
                )

    return map_texts(docs.select(F.col(text).alias("_text"), *(F.col(f"`{f.name}`") for f in fields)), run, schema)
