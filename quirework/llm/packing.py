"""Packing: power-of-two decomposition of tokenised documents.

Every document is cut into pieces whose lengths are powers of two, largest first: full pieces of
the capacity, then the binary digits of what remains. Equal lengths form a bucket and each piece
is a training sequence of its own, so no sequence crosses documents and none needs padding.

There is no exchange: a piece depends on one document only. ``sequence_id`` is the input
partition's number times 2**40 plus a running number in it; file scans split alike on a retry, so
a lost executor's task gives the same rows again.

Null and empty texts hold just the end token. Rows that repeat are packed each on their own; a
null doc_id stays null. Extra columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

END = 2
CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
_MOST_CACHED = 400_000

#: Words of these characters alone take the short way: lower-casing is per character there, they are
#: stable under NFC, and none is white space.
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xff]+")
#: The pre-tokenizer's pattern in the tokenizer's file.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """word (bytes) -> its ids as little-endian 32-bit words; white space never reaches an id.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids
    in a row. Kept entries are bounded: a full cache becomes the old one, from which words that come
    again are taken over, and the one before that is let go.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def piece(self, p: str) -> bytes:
        if (ids := self.pieces.get(p)) is None:
            if (ids := self.old_pieces.get(p)) is None:
                shown = p.encode().decode("latin-1").translate(byte_alphabet())
                ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(self.pieces) >= _MOST_CACHED:
                self.old_pieces, self.pieces = self.pieces, {}
            if len(p) < 64:
                self.pieces[p] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                ids = b"".join(map(self.piece, _PIECE.findall(text.lower())))
            else:
                ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= _MOST_CACHED:
            self.old = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = ids
        return ids


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@lru_cache(maxsize=2)
def word_ids(path: str | None) -> WordIds:
    return WordIds(path or default_tokenizer())


def pieces_of(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths, each a power of two of at most ``capacity``, that sum to n; largest first."""
    full, rest = divmod(n, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
]
_DDL = ", ".join(f"{n} long" for n, _ in _FIELDS)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids as array<int>.

    ``tokenizer``: path of the tokenizer's file on every executor (None: the installed package's).
    ``capacity`` must be a power of two. The bucket of a piece is its ``length``.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = pa.schema(_FIELDS + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, made = word_ids(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join(map(cache.__getitem__, text.as_py().split())) + end
                at, total = 0, len(ids) // 4
                for length in pieces_of(total, capacity):
                    own = ids[4 * at : 4 * (at + length)]
                    row = (doc, at, length, zlib.crc32(own), total, made, 0)
                    out.append((*row, np.frombuffer(own, "<i4")) if with_ids else row)
                    at, made = at + length, made + 1
                if len(out) >= (500 if with_ids else 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, _DDL + ", ids array<int>" * with_ids)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes pieces in one folder per length, so that a loader draws batches of equal lengths."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
