"""Removal of repeated passages: suffix automata of reference shards, matching statistics, maximal spans.

A window is `WINDOW` consecutive words of one text.  Every word in a window whose words also start anywhere else, in
another text or the same one, is removed.  All windows are judged on the input.

1. Texts with equal words are one class: if it has two members, all its windows are repeated.  One member goes on.
2. A window's anchor is its smallest run of `GRAM` words by hash, the first of equal ones.  Equal windows have equal
   anchors, and neighbouring windows mostly share theirs, so few of a text's words are anchors.  An anchor that is
   there only once has no repeated window; the others' neighbourhoods, the words of the windows that they own,
   are cut out.  Every occurrence of a window lies in exactly one neighbourhood of its anchor.
3. Equal neighbourhoods are counted before they move.  All of an anchor's different ones meet in one shard, whose
   suffix automaton knows how often each run of words ends in them.  The neighbourhoods are streamed through
   the automaton; where at least WINDOW words match a state that was reached twice, a window is repeated.  Overlapping
   windows make a maximal span.
4. Spans go back to their texts by the neighbourhoods' places, and the rest of the text is kept.

A shard takes the neighbourhoods of many anchors, about `SHARD_WORDS` words, so its automaton is bounded.  An anchor with
more than `VARIANTS` different neighbourhoods (a passage within very many different texts) is decided by counting its
windows themselves, which combine before they move; nothing is dropped.

Null and empty texts have no words and lose none.  Ids may be null, and repeated rows are copies of each other, so
their windows are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.scratch import Scratch
from callscope.llm.words import FACTORS, U64, Words, as_bytes, grams, mix, sized

WINDOW = 35
GRAM = 8
SHARD_WORDS = 100_000
VARIANTS = 2_000
_END = U64(0xFFFFFFFFFFFFFFFF)


def anchors(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, the place of its anchor, and the anchor's hash."""
    n = len(words.doc)
    at, hashes = grams(words.hashes(), words.doc, gram)
    keys = np.full(n, _END)
    keys[at] = hashes
    span = window - gram + 1
    best, reach = np.arange(n), 1
    while reach < span:
        step = min(reach, span - reach)
        ahead = best[np.minimum(np.arange(n) + step, n - 1)]
        best = np.where(keys[ahead] < keys[best], ahead, best)
        reach += step
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    starts = np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])
    return starts, best[starts], keys[best[starts]]


_SPANS = "array<struct<first:int,last:int>>"
_ROWS = "doc_id long, key long, n_words long, sha binary, anchors array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's word count, the digest of its words, and the hashes of its anchors, one per place."""
    for batch in batches:
        texts = as_bytes(batch.column(2))
        for low, high in sized(texts):
            some = texts[low:high]
            words = Words(some)
            _, place, keys = anchors(words)
            place, first = np.unique(place, return_index=True)
            edges = np.searchsorted(words.doc[place], np.arange(len(some) + 1))
            keys = keys[first].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys))
            shas = [hashlib.sha256(b" ".join(t.split())).digest() for t in some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(words.counts, pa.int64()), pa.array(shas, pa.binary()), lists],
                ["doc_id", "key", "n_words", "sha", "anchors"],
            )


_PLACES = "sha binary, at int, anchor long, passage binary"


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the windows that each of a text's repeated anchors owns, joined by spaces, and their place."""
    for batch in batches:
        texts, shas = as_bytes(batch.column(1)), batch.column(0)
        for low, high in sized(texts, 256 << 10):
            some = texts[low:high]
            words = Words(some)
            starts, place, keys = anchors(words)
            held = batch.column(2).slice(low, high - low)
            flat, sizes = held.flatten().to_numpy().view(U64), held.value_lengths().to_numpy()
            # An anchor counts as repeated for the texts that list it.
            wanted = np.unique(mix(flat ^ mix(np.repeat(np.arange(len(some)), sizes).astype(U64))))
            own = np.isin(mix(keys ^ mix(words.doc[starts].astype(U64))), wanted)
            starts, place, keys = starts[own], place[own], keys[own]
            breaks = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.empty(0, np.int64)
            last = np.concatenate((breaks[1:], [len(place)])) - 1 if len(place) else breaks
            begin, end = starts[breaks], starts[last] + WINDOW
            split = [t.split() for t in some]
            docs, offset = words.doc[begin], words.at[words.doc[begin]] if len(begin) else begin
            passages = [b" ".join(split[d][a:b]) for d, a, b in zip(docs.tolist(), (begin - offset).tolist(), (end - offset).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [shas.take(pa.array(docs + low)), pa.array(begin - offset, pa.int32()), pa.array(keys[breaks].view(np.int64)), pa.array(passages, pa.binary())],
                ["sha", "at", "anchor", "passage"],
            )


class SuffixAutomaton:
    """All runs of words of some passages, and how many times each ends in them."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, passage: list[int], times: int) -> None:
        """Take in a passage that is there so many times."""
        follow, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for word in passage:
            to = follow[last].get(word)
            if to is not None:
                # The run is known from another passage.
                if length[to] != length[last] + 1:
                    to = self._split(last, word, to)
                last = to
                count[last] += times
                continue
            new = len(length)
            follow.append({})
            link.append(0)
            length.append(length[last] + 1)
            count.append(times)
            at = last
            while at >= 0 and word not in follow[at]:
                follow[at][word] = new
                at = link[at]
            if at >= 0:
                to = follow[at][word]
                link[new] = to if length[to] == length[at] + 1 else self._split(at, word, to)
            last = new

    def _split(self, at: int, word: int, to: int) -> int:
        """A state of its own for the runs that end in `to` and are no longer than `at` and the word."""
        follow, link = self.next, self.link
        copy = len(self.length)
        follow.append(follow[to].copy())
        link.append(link[to])
        self.length.append(self.length[at] + 1)
        self.count.append(0)
        link[to] = copy
        while at >= 0 and follow[at].get(word) == to:
            follow[at][word] = copy
            at = link[at]
        return copy

    def close(self) -> None:
        """Add every run's ends to those of its suffixes, the longest runs first."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def spans(self, passage: list[int], window: int, least: int = 2) -> list[tuple[int, int]]:
        """Maximal spans (begin, end) of the passage's windows that end `least` times or more in the passages."""
        follow, link, length, count = self.next, self.link, self.length, self.count
        state = matched = 0
        out: list[tuple[int, int]] = []
        for i, word in enumerate(passage, 1):
            while state and word not in follow[state]:
                state = link[state]
                matched = length[state]
            if word in follow[state]:
                state = follow[state][word]
                matched += 1
            if matched >= window:
                # The state of the window itself: the shortest suffix state that is long enough.
                while length[link[state]] >= window:
                    state = link[state]
                    matched = length[state]
                if count[state] >= least:
                    if out and out[-1][1] >= i - window:
                        out[-1] = (out[-1][0], i)
                    else:
                        out.append((i - window, i))
        return out


def _shard(table: pa.Table) -> pa.Table:
    """Spans of a shard's different neighbourhoods (anchor, passage, n)."""
    numbers: dict[bytes, int] = {}
    coded = [[numbers.setdefault(w, len(numbers)) for w in p.split(b" ")] for p in table["passage"].to_pylist()]
    automaton = SuffixAutomaton()
    for passage, times in zip(coded, table["n"].to_pylist(), strict=True):
        automaton.add(passage, min(times, 2))
    automaton.close()
    rows, begins, ends = [], [], []
    for row, passage in enumerate(coded):
        for begin, end in automaton.spans(passage, WINDOW):
            rows.append(row)
            begins.append(begin)
            ends.append(end)
    take = pa.array(rows, pa.int64())
    return pa.table({"anchor": table["anchor"].take(take), "low": table["low"].take(take), "first": pa.array(begins, pa.int32()), "last": pa.array(ends, pa.int32())})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every window of the neighbourhoods (sha, at, passage), with its place."""
    factors = mix(FACTORS[:WINDOW] ^ U64(0x5851F42D4C957F2D)) | U64(1)
    for batch in batches:
        texts = as_bytes(batch.column(2))
        for low, high in sized(texts, 256 << 10):
            words = Words(texts[low:high])
            hashes = words.hashes()
            at, one = grams(hashes, words.doc, WINDOW)
            two = mix(sum((hashes[at + j] * factors[j] for j in range(WINDOW)), np.zeros(len(at), U64)))
            row = words.doc[at]
            places = batch.column(1).slice(low, high - low).to_numpy()[row] + (at - words.at[row])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row + low)), pa.array(places, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                ["sha", "at", "one", "two"],
            )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text (sha, text, spans): its words outside the spans, joined by spaces."""
    for batch in batches:
        texts, spans = as_bytes(batch.column(1)), batch.column(2)
        for low, high in sized(texts):
            merged, removed, shas = [], [], []
            for i, text in enumerate(texts[low:high], low):
                words = text.split()
                step = np.zeros(len(words) + 1, np.int64)
                for span in spans[i].as_py():
                    step[span["first"]] += 1
                    step[span["last"]] -= 1
                gone = np.cumsum(step[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
                merged.append([{"first": a, "last": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join([words[j] for j in np.flatnonzero(~gone).tolist()])).hexdigest())
            spans_of = pa.array(merged, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), spans_of, pa.array(removed, pa.int64()), pa.array(shas)], ["sha", "spans", "n_removed", "kept_sha256"])


def _candidates(scratch: Scratch, source: DataFrame, classes: DataFrame) -> DataFrame:
    """(sha, members, text, anchors): one text of each class that holds repeated anchors, with those."""
    # A short name of the class; if two ever share it, their texts list some anchors in vain.
    name = F.xxhash64("sha")
    places = classes.select(name.alias("name"), F.explode("anchors").alias("anchor"))
    # Stored before the join, so that an anchor with very many places is split there.
    repeated = scratch.keep(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    hits = scratch.keep(places.join(repeated, "anchor").groupBy("name").agg(F.collect_set("anchor").alias("anchors")))
    asked = scratch.keep(
        hits.join(classes.select(name.alias("name"), "sha", "members", "copies", F.col("doc_id").alias("_id"), F.col("key").alias("_key")), "name").drop("name")
    )
    scratch.drop(repeated, hits)
    found = source.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    columns = ["sha", "members", "text", "anchors"]
    out = found.where("copies = 1").select(*columns)
    if not asked.where("copies > 1").isEmpty():
        out = out.union(found.where("copies > 1").select(*columns).dropDuplicates(["sha"]))
    out = scratch.keep(out)
    scratch.drop(asked)
    return out


def _found(scratch: Scratch, passages: DataFrame) -> DataFrame:
    """(sha, first, last): spans of repeated windows at their places in the texts."""
    different = scratch.keep(passages.groupBy("anchor", "passage").agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.xxhash64("passage")))
    variants = scratch.keep(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n")).where("n > 1").select("anchor", "variants"))
    kinds = different.join(variants, "anchor")
    # A neighbourhood that is all an anchor has matches itself from end to end.
    whole = kinds.where("variants = 1").select("anchor", "low", F.lit(0).alias("first"), F.size(F.split(F.col("passage").cast("string"), " ")).alias("last"))
    several = kinds.where(F.col("variants").between(2, VARIANTS))
    size = several.agg(F.sum(F.length("passage"))).first()[0] or 0
    shards = max(1, int(size // (7 * SHARD_WORDS)))
    decided = (
        several.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "low", "passage", "n")
        .groupBy("shard")
        .applyInArrow(_shard, "anchor long, low long, first int, last int")
    )
    spans = scratch.keep(whole.union(decided))
    placed = passages.select("sha", "at", "anchor", F.xxhash64("passage").alias("low")).join(spans, ["anchor", "low"]).select(
        "sha", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")
    )
    hot = scratch.keep(variants.where(F.col("variants") > VARIANTS).select("anchor"))
    used = [different, variants, spans, hot]
    if not hot.isEmpty():
        windows = scratch.keep(passages.join(hot, "anchor").select("sha", "at", "passage").mapInArrow(_windows, "sha binary, at int, one long, two long"))
        twice = scratch.keep(windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two"))
        placed = placed.union(windows.join(twice, ["one", "two"]).select("sha", F.col("at").alias("first"), (F.col("at") + WINDOW).alias("last")))
        used += [windows, twice]
    out = scratch.keep(placed.groupBy("sha").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    scratch.drop(*used)
    return out


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, spans (removed words, from `first` up to but without `last`), n_removed and kept_sha256 of each row."""
    scratch = Scratch(docs.sparkSession, "repeats")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    rows = scratch.keep(source.mapInArrow(_scan, _ROWS))
    long = rows.where(F.col("n_words") >= WINDOW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key"))
    heads = scratch.keep(
        long.groupBy("sha").agg(first.alias("head"), F.count(F.lit(1)).alias("members"))
        .select(F.col("sha").alias("_sha"), F.col("head.doc_id").alias("_id"), F.col("head.key").alias("_key"), "members")
    )
    head = (F.col("sha") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    classes = scratch.keep(
        long.groupBy("sha", "doc_id", "key").agg(F.count(F.lit(1)).alias("copies"), F.any_value("anchors").alias("anchors"))
        .join(heads, head).select("sha", "doc_id", "key", "members", "copies", "anchors")
    )
    candidates = _candidates(scratch, source, classes)
    passages = scratch.keep(candidates.select("sha", "text", "anchors").mapInArrow(_neighbourhoods, _PLACES))
    spans = _found(scratch, passages)
    left = scratch.keep(
        candidates.where("members = 1").select("sha", "text").join(spans, "sha").mapInArrow(_remove, f"sha binary, spans {_SPANS}, n_removed long, kept_sha256 string")
    )
    every = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last")))
    done = scratch.keep(
        classes.select("sha", "members").join(left, "sha", "left").where("members > 1 or n_removed is not null")
        .select(F.col("sha").alias("_sha"), "members", "spans", F.col("n_removed").alias("_removed"), "kept_sha256")
    )
    scratch.drop(heads, classes, candidates, passages, spans, left)
    copied = F.col("members") > 1
    return rows.join(done, F.col("sha") == F.col("_sha"), "left").select(
        "doc_id",
        "n_words",
        F.when(copied, every).otherwise(F.coalesce("spans", F.array().cast(_SPANS))).alias("spans"),
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
