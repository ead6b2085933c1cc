"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of
* the text's likelihood under hashed byte trigrams, counted over every document that declares one of `LANGUAGES`;
* the declared markup language and the address suffix, by how often each goes with a language;
* the host's prior, smoothed towards its domain's, and that towards the whole corpus's.
The last three come from grouped aggregation over all documents' text votes, a document's own vote
left out.  A uniform distribution stands for languages that are not known.

Null or missing evidence says nothing.  Texts without a trigram vote for nothing and are judged by the
rest.  A document is rejected if the unknown language is the most probable one, if no language reaches
`MIN_POSTERIOR`, or if its text has no word.  Repeated rows are judged once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.batches import map_texts
from callscope.llm.counts import SCHEMA, in_parts, summed
from callscope.llm.words import Words, as_bytes, sized
from callscope.session import scratch_dir

LANGUAGES = ("de", "en", "es", "fr")
BUCKET_BITS = 16
MIN_POSTERIOR = 0.5
UNKNOWN_PRIOR = 0.01
HOST_STRENGTH = 20.0  # votes that a host's prior takes from its domain, and that from the corpus
FIELD_STRENGTH = 1.0
#: Overlapping trigrams repeat each other's evidence.
TEMPER = 1 / 3
#: Tables of so many hosts or suffixes at most are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[0x09:0x0E] = 0x20


def trigrams(words: Words) -> np.ndarray:
    """Hash bucket of the three bytes from each place on."""
    data = _SPACES[words.data].astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    keys = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return (keys * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(LANGUAGES), 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        texts, declared = as_bytes(batch.column(0)), batch.column(1).to_pylist()
        for low, high in sized(texts):
            some = list(zip(texts[low:high], declared[low:high], strict=True))
            for n, language in enumerate(LANGUAGES):
                own = [t for t, d in some if d == language]
                if own:
                    counts[n] += np.bincount(trigrams(Words(own, lower=True)), minlength=counts.shape[1])
    yield in_parts(counts)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Smoothed log probability of each bucket by language, relative to a uniform one."""
    smooth = counts + 0.5
    return np.log(smooth / smooth.sum(axis=1, keepdims=True)) + BUCKET_BITS * np.log(2)


def score_texts(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio of each text and language against the uniform one, and the number of words."""
    words = Words(texts, lower=True)
    out = np.zeros((len(texts), len(table)))
    keys = trigrams(words)
    some = np.flatnonzero(words.lengths >= 3)
    if len(some):
        edges = np.column_stack([words.first[some], words.first[some] + words.lengths[some] - 2]).ravel()
        edges = edges if edges[-1] < len(keys) else edges[:-1]
        for n, row in enumerate(table):
            out[some, n] = np.add.reduceat(row[keys], edges)[::2]
    return out * TEMPER, words.counts


def language_code(field: str | Column) -> Column:
    """Primary part of a language tag, in lower case."""
    column = F.col(field) if isinstance(field, str) else field
    return F.nullif(F.lower(F.regexp_extract(column, r"^\s*([A-Za-z]{2,3})(?:[-_]|\s*$)", 1)), F.lit(""))


def train(docs: DataFrame, text: str = "text", declared: str = "lang") -> np.ndarray:
    """Log probabilities of the trigram buckets, from all documents with a known declared language."""
    parts = map_texts(docs.select(F.col(text).alias("text"), language_code(declared).alias("declared")), _count, SCHEMA)
    return log_probabilities(summed(parts, len(LANGUAGES), 1 << BUCKET_BITS))


def with_likelihoods(docs: DataFrame, table: np.ndarray, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` with _likelihoods, _vote (number of the likeliest language) and _words."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    fields = [docs.schema[name] for name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["_likelihoods array<double>, _vote int, _words long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for low, high in sized(texts):
                scores, n = score_texts(texts[low:high], shared.value)
                votes = pa.array(scores.argmax(axis=1).astype(np.int32), mask=~scores.any(axis=1))
                kept = [batch.column(i + 1).slice(low, high - low) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(list(scores)), votes, pa.array(n)], [*keep, "_likelihoods", "_vote", "_words"])

    return map_texts(docs.select(F.col(text).alias("_text"), *(F.col(f"`{name}`") for name in keep)), run, schema)


def _votes(seen: DataFrame, *by: Column) -> DataFrame:
    """Votes for each language, as an array, in every group."""
    sums = [F.sum((F.col("_vote") == n).cast("long")).cast("double") for n in range(len(LANGUAGES))]
    return seen.where("_vote is not null").groupBy(*by).agg(F.array(*sums).alias("votes"))


def _attach(rows: DataFrame, table: DataFrame, key: Column, name: str) -> DataFrame:
    """`rows` with a table's votes by key; the table is broadcast if its measured size allows it."""
    path = scratch_dir(rows.sparkSession, f"language-{name}")
    table.where("key is not null").write.parquet(path)
    table = rows.sparkSession.read.parquet(path)
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    return rows.join(table.select(F.col("key").alias(f"_{name}_key"), F.col("votes").alias(f"_{name}")), key == F.col(f"_{name}_key"), "left").drop(f"_{name}_key")


def domain(host: Column) -> Column:
    """The last two labels of a host, or the name itself."""
    return F.substring_index(host, ".", -2)


def fuse(rows: DataFrame, seen: DataFrame, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """`rows` with language, posterior, text_language and kept.

    Both frames have _likelihoods, _vote, _words, _declared, _suffix and _host; `seen` holds every document, and
    what it says about hosts and fields is applied to `rows`.
    """
    n = len(LANGUAGES)
    zeros = F.array(*[F.lit(0.0)] * n)
    overall = _votes(seen).first()
    overall = list(overall["votes"]) if overall and overall["votes"][0] is not None else [0.0] * n
    total = sum(overall)
    base = [(x + 1) / (total + n) for x in overall]
    rows = _attach(rows, _votes(seen, F.col("_declared").alias("key")), F.col("_declared"), "by_declared")
    rows = _attach(rows, _votes(seen, F.col("_suffix").alias("key")), F.col("_suffix"), "by_suffix")
    rows = _attach(rows, _votes(seen, F.col("_host").alias("key")), F.col("_host"), "by_host")
    rows = _attach(rows, _votes(seen, domain(F.col("_host")).alias("key")), domain(F.col("_host")), "by_domain")
    rows = rows.withColumns({f"_by_{x}": F.coalesce(f"_by_{x}", zeros) for x in ("declared", "suffix", "host", "domain")})

    def others(level: str, i: int, value: str) -> tuple[Column, Column]:
        """Votes for a language, and all votes, of a group without the row's own."""
        votes, has = F.col(f"_by_{level}"), F.col(value).isNotNull()
        own = F.when(has & (F.col("_vote") == i), 1.0).otherwise(0.0)
        voted = F.when(has & F.col("_vote").isNotNull(), 1.0).otherwise(0.0)
        everyone = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x)
        return F.greatest(votes[i] - own, F.lit(0.0)), F.greatest(everyone - voted, F.lit(0.0))

    def prior(level: str, i: int, above: Column) -> Column:
        mine, everyone = others(level, i, "_host")
        return (mine + above * HOST_STRENGTH) / (everyone + HOST_STRENGTH)

    def field(name: str, i: int) -> Column:
        """log P(value | language) up to a term that is equal for all languages; 0 without a value."""
        mine, everyone = others(name, i, f"_{name}")
        share = (everyone + FIELD_STRENGTH) / (total + FIELD_STRENGTH * n)
        return F.when(everyone == 0, F.lit(0.0)).otherwise(F.log((mine + share * FIELD_STRENGTH) / (overall[i] + FIELD_STRENGTH) / share))

    scores = [
        F.col("_likelihoods")[i] + field("declared", i) + field("suffix", i) + F.log(prior("host", i, prior("domain", i, F.lit(base[i]))) * (1 - UNKNOWN_PRIOR))
        for i in range(n)
    ]
    rows = rows.withColumn("_scores", F.array(*scores, F.lit(float(np.log(UNKNOWN_PRIOR)))))
    top = F.array_max("_scores")
    spread = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("_scores")))
    names = F.array(*map(F.lit, LANGUAGES))
    best = F.array_position("_scores", top).cast("int")
    rows = rows.withColumns({"posterior": F.lit(1.0) / spread, "language": F.when(best <= n, F.get(names, best - 1)), "text_language": F.get(names, F.col("_vote"))})
    kept = F.col("language").isNotNull() & (F.col("posterior") >= min_posterior) & (F.col("_words") > 0)
    return rows.withColumn("kept", F.coalesce(kept, F.lit(False))).drop("_scores", "_by_declared", "_by_suffix", "_by_host", "_by_domain")
