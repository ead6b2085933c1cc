"""Best-fit packing: documents of token ids into sequences of at most `CAPACITY` tokens.

Each task packs the documents it reads, in their order, into a fixed number of open sequences.  A bitset
keyed by free space finds the tightest open sequence that a piece fits; where none does, a new one is
opened, and the fullest is closed first if all places are taken.  Tasks need no exchange, and a
repeated task packs its documents alike.

A document's ids are its tokens and the end id 0; longer ones are cut into pieces of CAPACITY.  Null and
empty texts are one end id.  Repeated rows are packed once each; ids may be null.

Tokens come from the library word by word: its normaliser, special tokens and word pattern never
look across ASCII white space, so a text's ids are those of its words in order, and frequent
words are looked up in tables of about `CACHED_WORDS` and `CACHED_PARTS` entries at most.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.batches import map_texts, worker_table
from callscope.llm.words import as_bytes, sized

CAPACITY = 2048
OPEN_SEQUENCES = 512
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 400_000
CACHED_PARTS = 200_000
# Fixed rules of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PARTS = regex.compile(PATTERN + r"|\n")
#: Characters that composing leaves alone and that lower-case alike everywhere.
_PLAIN = re.compile(r"[!-~\u00a1-\u012f\u0131-\u024f]*\Z")
_END = b"\0\0\0\0"
_MARK, _SIMPLE, _SPACE = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b",.", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b" \t\n\r\x0b\x0c"))

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def marks_apart(texts: list[bytes]) -> list[bytes]:
    """The texts with a space before each comma or full stop that ends a word after an ASCII letter or digit.

    Such a mark is a part of its own in the library's pattern, so the ids stay the same and the word before it is
    one that is known without its mark.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    at = np.flatnonzero(_MARK[data[1:-1]] & _SIMPLE[data[:-2]] & _SPACE[data[2:]]) + 1 if len(data) > 2 else np.empty(0, np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    moved = (ends + np.searchsorted(at, ends)).tolist()
    out = np.insert(data, at, 0x20).tobytes()
    return [out[a : b - 1] for a, b in zip([0, *moved], moved, strict=False)]


class WordTokens:
    """Token ids of words, as little-endian unsigned 32-bit numbers.

    New words go to the library.  Where its rules are the ones below, plain Latin words are split into the parts
    that its pattern finds and only parts not seen before go to its BPE model; that gives the same ids
    and leaves out its normaliser, which costs more than the merges do.
    """

    def __init__(self, vocabulary: str):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        rules = json.loads(self.library.to_str())
        self.by_parts = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.comma = self.model.encode(",", add_special_tokens=False).ids[0]
        letters = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        rest = [b for b in range(256) if b not in letters]
        self.letters = letters | {b: chr(256 + n) for n, b in enumerate(rest)}

    def _spelled(self, part: str) -> str:
        return part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)

    def _encode_parts(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of lower-case parts, each of which the library's pattern finds as a whole."""
        for low in range(0, len(parts), 4096):
            some = parts[low : low + 4096]
            got = self.model.encode(" ".join(map(self._spelled, some)), add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            at = (4 * np.searchsorted(np.array(got.word_ids), np.arange(len(some) + 1))).tolist()
            yield from (ids[a:b] for a, b in zip(at, at[1:], strict=False))

    def _add_letters(self, words: list[bytes], lower: list[str]) -> None:
        """Plain words of letters alone are one part each, and need no table of parts; commas keep them apart."""
        for low in range(0, len(words), 4096):
            some = words[low : low + 4096]
            got = self.model.encode_batch_fast([" , ".join([*map(self._spelled, lower[low : low + 4096]), ""])], add_special_tokens=False)[0]
            flat = np.array(got.ids, "<u4")
            ids, ends = flat.tobytes(), (4 * np.flatnonzero(flat == self.comma)).tolist()
            self.known.update(zip(some, [ids[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)], strict=True))

    def _add_plain(self, words: list[bytes]) -> None:
        parts = _PARTS.findall(b"\n".join([*words, b""]).decode().lower())
        new = list({x for x in parts if x != "\n" and x not in self.parts})
        self.parts.update(zip(new, self._encode_parts(new), strict=True))
        own: list[bytes] = []
        done = iter(words)
        for x in parts:
            if x == "\n":
                self.known[next(done)] = b"".join(own)
                own = []
            else:
                own.append(self.parts[x])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in (marks_apart(texts) if self.by_parts else texts)]
        # Two generations of words: what is still in use is carried over, so a full table costs no second encoding.
        if len(self.known) > CACHED_WORDS // 2:
            self.older, self.known = self.known, {}
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        known = self.known
        new = set().union(*split).difference(known)
        if self.older:
            again = {w for w in new if w in self.older}
            known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            new -= again
        words = list(new)
        if self.by_parts and words:
            letters, spelled, plain = [], [], []
            for word, x in zip(words, b"\n".join(words).decode().split("\n"), strict=True):
                if x.isalpha():
                    if x.isascii() or _PLAIN.match(x):
                        letters.append(word)
                        spelled.append(x)
                elif _PLAIN.match(x) and "<|" not in x:
                    plain.append(word)
            self._add_letters(letters, "\n".join(spelled).lower().split("\n") if spelled else [])
            self._add_plain(plain)
        rest = [w for w in words if w not in known]
        got = self.library.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        known.update(zip(rest, (np.array(x.ids, "<u4").tobytes() for x in got), strict=True))
        return [b"".join(map(known.__getitem__, own)) for own in split]


def word_tokens(vocabulary: str = VOCABULARY) -> WordTokens:
    """One table per Python worker."""
    return worker_table(vocabulary, lambda: WordTokens(vocabulary))


class Packer:
    """Open sequences by free space; `place` gives a piece's sequence number and offset."""

    def __init__(self, capacity: int = CAPACITY, places: int = OPEN_SEQUENCES):
        self.capacity, self.places = capacity, places
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, free: int) -> int:
        here = self.by_free[free]
        sequence = here.pop()
        if not here:
            self.bits ^= 1 << free
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            sequence = self._take(free)
        else:
            if self.open == self.places:
                self._take((self.bits & -self.bits).bit_length() - 1)
            sequence, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(sequence)
            self.open += 1
        return sequence, self.capacity - free


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its token ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packer, tokens = Packer(), word_tokens(vocabulary)
        for batch in batches:
            texts, names = as_bytes(batch.column(1)), batch.column(0).to_pylist()
            for low, high in sized(texts):
                rows: list[list] = [[] for _ in range(8)]
                for name, ids in zip(names[low:high], tokens.encode(texts[low:high]), strict=True):
                    ids += _END
                    for piece, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                        part = ids[at : at + 4 * CAPACITY]
                        sequence, offset = packer.place(len(part) // 4)
                        row = (name, piece, at // 4, len(part) // 4, zlib.crc32(part), base + sequence, offset, np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None)
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())][: 7 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids)

    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, PIECES + ", ids array<int>" * with_ids, vocabulary)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id with its documents and token ids in order; a sequence holds at most CAPACITY tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"), F.flatten("parts.ids").alias("ids")
    )
