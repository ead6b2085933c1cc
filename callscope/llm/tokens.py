"""Token counts of whole texts, huge ones by overlapping chunks that are spliced together.

Texts up to `WHOLE_BYTES` are counted as they are.  Longer ones are cut into chunks that overlap,
dealt out over the cluster, and encoded with offsets.  Two neighbours are spliced at the first offset in
their overlap at which both start a token and which is proven stable: a space after a character
that is neither a space nor the word mark.  The vocabulary is checked for that: no piece has a word mark after another
character, so no merge crosses such a place.  Where neighbours have no such offset in common, the
text is encoded anew with a wider overlap, in the end as one chunk.

Null and empty texts have no tokens.  Repeated rows are counted once each; ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.words import as_bytes, sized
from callscope.session import scratch_dir

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
WHOLE_BYTES = 32_768
CHUNK = 16_384  # bytes
OVERLAP = 256
WIDEN = 16
_MARK = "▁"

_loaded: dict[str, tuple] = {}


def processor(vocabulary: str = VOCABULARY) -> tuple:
    """The library's processor, and whether stable boundaries are proven for its vocabulary."""
    if vocabulary not in _loaded:
        import public_tokenizers
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        path = public_tokenizers.path(vocabulary)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        stable = all(_MARK not in p.piece.lstrip(_MARK) and p.type != kinds.USER_DEFINED for p in model.pieces)
        _loaded[vocabulary] = sentencepiece.SentencePieceProcessor(model_file=path), bool(plain and stable and not model.trainer_spec.treat_whitespace_as_suffix)
    return _loaded[vocabulary]


def is_stable(text: bytes, at: int) -> bool:
    """Whether no merge can cross this place."""
    return text[at] == 0x20 and text[at - 1] != 0x20 and text[max(0, at - 3) : at] != _MARK.encode()


def chunks(text: bytes, overlap: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes, int, int]]:
    """Start and text of each chunk, the end of the one before and the start of the one after."""

    def character(at: int) -> int:
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(text))

    start = before = 0
    while True:
        following, end = character(start + chunk), character(start + chunk + overlap)
        yield start, text[start:end], before, following
        if end == len(text):
            return
        start, before = following, end


def boundaries(text: bytes, start: int, before: int, following: int, vocabulary: str = VOCABULARY) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """Number of tokens of a chunk; stable token starts in its first and in its last overlap, as
    (offset in the whole text, tokens of the chunk before it)."""
    found = processor(vocabulary)[0].encode(text.decode(), return_type="proto").pieces
    head, tail = [], []
    for n, piece in enumerate(found):
        at = piece.begin
        if 0 < at < len(text) and (start + at < before or start + at >= following) and is_stable(text, at):
            if start + at < before:
                head.append((start + at, n))
            if start + at >= following:
                tail.append((start + at, n))
    return len(found), head, tail


_ENDS = "row string, chunk int, n long, head array<struct<at: long, n: long>>, tail array<struct<at: long, n: long>>"


def _count_chunked(long: DataFrame, vocabulary: str, overlap: int) -> DataFrame:
    """row, n_tokens (null where two neighbours can't be aligned)."""
    spark = long.sparkSession

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                for n, (start, part, before, following) in enumerate(chunks(text, overlap)):
                    yield pa.RecordBatch.from_pydict({"row": [row], "chunk": pa.array([n], pa.int32()), "start": [start], "before": [before], "following": [following], "part": [part]})

    def encode(batches):
        ends = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
        pairs = lambda x: [{"at": at, "n": n} for at, n in x]
        for batch in batches:
            places = zip(as_bytes(batch.column(5)), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            got = [boundaries(*place, vocabulary) for place in places]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array([pairs(g[1]) for g in got], ends), pa.array([pairs(g[2]) for g in got], ends)],
                ["row", "chunk", "n", "head", "tail"],
            )

    parts = long.select("row", "text").mapInArrow(cut, "row string, chunk int, start long, before long, following long, part binary")
    parts = parts.repartition("row", "chunk")
    path = scratch_dir(spark, "token-chunks")
    parts.mapInArrow(encode, _ENDS).write.parquet(path)
    ends = spark.read.parquet(path)
    after = ends.select("row", (F.col("chunk") - 1).alias("chunk"), F.col("head").alias("next"), F.lit(True).alias("more"))
    at = F.array_min(F.array_intersect("tail.at", "next.at"))
    tokens = lambda side: F.get(F.filter(side, lambda x: x["at"] == at), 0)["n"]
    own = F.when(F.col("more").isNull(), F.col("n")).otherwise(tokens("tail") - tokens("next"))
    return (
        ends.join(after, ["row", "chunk"], "left")
        .select("row", own.alias("own"))
        .groupBy("row")
        .agg(F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens"))
    )


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    huge = F.coalesce(F.octet_length("text") > WHOLE_BYTES, F.lit(False))

    def count(batches):
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for low, high in sized(texts):
                some = texts[low:high]
                part = [t.decode() for t in some]
                ids = processor(vocabulary)[0].encode(part, num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array([len(t) for t in some], pa.int64()), pa.array([len(i) for i in ids], pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    def number(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = pa.array([f"{task}-{n + i}" for i in range(batch.num_rows)])
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, *batch.columns], ["row", "doc_id", "n_bytes", "text"])

    kind = source.schema["doc_id"].dataType.simpleString()
    counted = source.where(~huge).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    path = scratch_dir(spark, "token-texts")
    long = source.where(huge).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    long.mapInArrow(number, f"row string, doc_id {kind}, n_bytes long, text string").write.parquet(path)
    long = spark.read.parquet(path)
    overlap = OVERLAP if processor(vocabulary)[1] else None
    rest, done = long, []
    while not rest.isEmpty():
        if overlap is None:  # nothing is proven: one chunk each
            overlap = 1 << 31
        path = scratch_dir(spark, "token-counts")
        _count_chunked(rest, vocabulary, overlap).write.parquet(path)
        got = spark.read.parquet(path)
        done.append(got.where("n_tokens is not null"))
        rest = rest.join(got.where("n_tokens is null"), "row", "left_semi")
        overlap *= WIDEN
    for got in done:
        spliced = long.join(got, "row").select("doc_id", "n_bytes", "n_tokens")
        counted = counted.union(spliced)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
