"""WARC archives compressed with Zstandard: one frame per record, after a skippable frame with the dictionary.

Writing: each task writes one archive through Spark's text writer, so files appear whole or not at all on
any file system.  A row is one frame; the line separator is an empty skippable frame, which
decoders pass over.  Payloads that occur before, in the order of page ids, become revisits.

Reading: the dictionary is loaded from the leading skippable frame, every record is decoded from
its own frame, and version, headers, lengths and digests are checked.  What is wrong is named in
`error`; nothing is skipped.

A null payload is empty, a null URL leaves its header out.  A null page id names the record
`<urn:page:>`.  Rows that repeat the smallest page id of a payload are all responses.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.words import as_bytes

MIN_SHARED = 100
DATE = "2024-01-01T00:00:00Z"
SAMPLES = 400  # payload heads of which the dictionary is made
SAMPLE_CHARS = 4096
DICTIONARY_BYTES = 16_384
# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
BETWEEN = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"

RECORDS = (
    "path string, offset long, record_type string, record_id string, target_uri string, date string, "
    "payload_bytes long, payload_digest string, refers_to string, error string"
)


def dictionary(payloads: DataFrame, payload: str) -> bytes:
    """Trained on a bounded sample, the heads of `SAMPLES` payloads; none if they are too few or too alike."""
    heads = payloads.select(F.substring(payload, 1, SAMPLE_CHARS).alias("head")).where("length(head) > 0").withColumn("hash", F.xxhash64("head"))
    # The sample's bound is found on hashes alone, so tasks hand over no heads but those that are taken.
    bound = heads.select("hash").distinct().orderBy("hash").limit(SAMPLES).agg(F.max("hash")).first()[0]
    rows = [] if bound is None else heads.where(F.col("hash") <= bound).distinct().orderBy("hash", "head").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["head"].encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(kind: str, name: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record around an HTTP response; a revisit carries the response's head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD_ID}{name}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in uri))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", keep_unique: int = MIN_SHARED) -> None:
    """One record per row; payloads of at least `keep_unique` bytes are stored once."""
    spark = pages.sparkSession
    trained = dictionary(pages, payload)
    rows = pages.select(
        F.col(page_id).cast("string").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"), F.col(page_id).alias("page_id")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.octet_length("payload") >= keep_unique)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("of"), "first")
    )
    is_first = F.coalesce(F.col("page_id") == F.col("first"), F.col("first").isNull())
    typed = rows.join(firsts, F.col("digest") == F.col("of"), "left").select(
        "id", "url", F.when(is_first, F.col("payload")).alias("payload"), F.octet_length("payload").alias("size"), "digest", F.when(~is_first, F.col("first").cast("string")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        pack = zstandard.ZstdCompressor(dict_data=shared, write_checksum=True)
        first = True
        for batch in batches:
            id_, url_, _, size, digest, refers = (c.to_pylist() for c in batch.columns)
            frames = [struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained] if first and trained else []
            first = False
            for i, body in enumerate(as_bytes(batch.column(2))):
                kind = "response" if refers[i] is None else "revisit"
                # A revisit's HTTP head states the length of the payload that it stands for.
                content = record(kind, id_[i] or "", url_[i], body if kind == "response" else bytes(size[i]), digest[i], refers[i])
                frames.append(pack.compress(content))
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    frames = typed.mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", BETWEEN).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """End of the frame that starts here, from its block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise ValueError("the frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            at += 4 * (flags >> 2 & 1)
            if at > len(data):
                raise ValueError("the frame is cut off")
            return at


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes
    error: str | None


def parse_record(content: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Headers, payload and what is wrong with a record."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines[1:]) if colon}
    if not gap or not lines[0].startswith("WARC/1."):
        return headers, b"", "no WARC head"
    missing = [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if h not in headers]
    if missing:
        return headers, b"", f"no {missing[0]}"
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        return headers, b"", "wrong length"
    block = rest[:-4]
    if headers.get("warc-block-digest", d := f"sha256:{hashlib.sha256(block).hexdigest()}") != d:
        return headers, b"", "wrong block digest"
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((line.split(b":")[1].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), b"")
    headers["http-length"] = stated.decode()
    if headers["warc-type"] == "revisit":
        if "warc-refers-to" not in headers or "warc-payload-digest" not in headers:
            return headers, payload, "a revisit without its response"
    elif stated != str(len(payload)).encode():
        return headers, payload, "wrong payload length"
    return headers, payload, None


def read_records(archive: bytes) -> Iterator[Record]:
    """The records of one archive, each from its own frame; one that can't be decoded is reported, and the next one follows."""
    data, at = memoryview(archive), 0
    unpack = zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            yield Record(at, {}, b"", "bytes after the last frame")
            return
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                yield Record(at, {}, b"", "a skippable frame is cut off")
                return
            if magic == DICTIONARY_MAGIC and at == 0:
                stored = bytes(data[8 : 8 + size])
                if stored[:4] == struct.pack("<I", FRAME_MAGIC):
                    stored = zstandard.ZstdDecompressor().decompress(stored)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            yield Record(at, {}, b"", "not a frame")
            return
        try:
            end = frame_end(data, at)
        except (ValueError, IndexError) as wrong:
            yield Record(at, {}, b"", str(wrong))
            return
        try:
            # Frames of streaming compressors do not state their content's size.
            frame = unpack.decompressobj()
            content = frame.decompress(data[at:end])
            headers, payload, error = parse_record(content) if frame.eof else ({}, b"", "the frame is cut off")
        except (ValueError, zstandard.ZstdError) as wrong:
            headers, payload, error = {}, b"", str(wrong)
        yield Record(at, headers, payload, error)
        at = end


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record; a revisit's length and digest are those that it states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"] * with_payload
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), *[pa.string()] * 3, pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                rows = []
                for r in read_records(content):
                    h, error = r.headers, r.error
                    bare = lambda k: h[k].strip("<>") if k in h else None  # noqa: E731, B023
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    size = len(r.payload)
                    if h.get("warc-type") == "revisit":
                        size = int(h["http-length"]) if h.get("http-length", "").isdigit() else None
                    else:
                        own = hashlib.sha256(r.payload).hexdigest()
                        error, digest = error or ("wrong payload digest" if digest not in (None, own) else None), own
                    rows.append((file, r.offset, h.get("warc-type"), bare("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), size, digest, bare("warc-refers-to"), error, r.payload))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)][: len(names)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)][: len(names)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS + ", payload binary" * with_payload)


def page_of(record_id: str | Column) -> Column:
    """Page id of a record's name, null for a page without one."""
    column = F.col(record_id) if isinstance(record_id, str) else record_id
    return F.when(F.length(column) > len(RECORD_ID), F.substring(column, len(RECORD_ID) + 1, 20).cast("long"))


def resolve(records: DataFrame) -> DataFrame:
    """Records with revisits checked against, and measured by, the response that they refer to."""
    responses = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("to_id"), F.col("payload_digest").alias("to_digest")).agg(F.max("payload_bytes").alias("to_bytes"))
    revisits = records.where("record_type = 'revisit'").join(responses, (F.col("refers_to") == F.col("to_id")) & (F.col("payload_digest") == F.col("to_digest")), "left")
    lost = F.when(F.col("to_id").isNull(), F.lit("its response is missing"))
    checked = revisits.withColumn("error", F.coalesce("error", lost)).withColumn("payload_bytes", F.col("to_bytes")).select(records.columns)
    return records.where("record_type is null or record_type <> 'revisit'").union(checked)
