"""Shared helpers: table reads, stage tables in the shared folder, and numpy views of text batches.

Texts travel to Python as UTF-8 bytes. A word is a run of bytes outside 0x20 and 0x09-0x0D
(`[^\\x20\\x09-\\x0D]+`), which is what ``bytes.split()`` yields; a null text counts as empty.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

LETTER = r"\p{L}"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text (fold 0)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def text_bytes(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias("text")


def text_key(name: str = "text") -> Column:
    """With doc_id, names a row: rows equal in both are interchangeable."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit(""))).alias("text_key")


# ---------------------------------------------------------------- stage tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a temporary one if Spark runs in
    this process alone, else an error: executors elsewhere could not read what others wrote."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    own = conf or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='quirework-')}"
        spark.conf.set("spark.checkpoint.dir", own)
        atexit.register(_remove, spark, own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


class Stage:
    """A table written to the shared folder, so that later steps don't depend on executors' memory.

    ``drop()`` removes it once nothing reads it any more; what is left goes when the driver exits.
    """

    def __init__(self, df: DataFrame, label: str, options: dict[str, str] | None = None):
        self.spark = df.sparkSession
        ship(self.spark)
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.options(compression="zstd", **options or {}).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(_remove, self.spark, self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished jobs now, which bounds the disk in use."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- which keys repeat

BITS = 1 << 26


def repeated_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of BITS positions (8 MB, whatever the input) with the places of all values of ``key``,
    a fingerprint, that occur more than once.

    It lets a second pass leave out nearly all rows of unique keys before they travel. What it lets
    through is checked exactly afterwards, so a full bitmap costs time, not results."""
    place = F.pmod(F.col("key"), F.lit(BITS)) + 1
    again = keys.groupBy("key").count().filter("count > 1")
    parts = again.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for at, bits in parts.toLocalIterator():
        out[(at - 1) * 4096 : at * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def key_batch(keys: np.ndarray) -> pa.RecordBatch:
    """Each distinct key once, or twice if it occurs more than once: all that ``repeated_bits`` needs."""
    found, n = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([found, found[n > 1]]).view(np.int64))], names=["key"])


# ---------------------------------------------------------------- numpy views of texts


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a binary column without nulls, without a copy."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """The words of a block of texts: start and end byte, row, and a 64-bit hash of each.

    ``inside`` tells for each of the 256 bytes whether it is part of a word (None: all but white space).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, seed: int = 1, inside: np.ndarray | None = None):
        self.rows = len(offsets) - 1
        n = len(data)
        word = ~_SPACE[data] if inside is None else inside[data]
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[1:n]
        self.start = np.flatnonzero(begins)
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:n]
        self.end = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=self.rows).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.count)])
        if len(self.start):
            size = np.diff(np.append(self.start, n))
            at = np.arange(self.start[0], n) - np.repeat(self.start, size)
            shown = (_LOWER[data] if lower else data)[self.start[0] :]
            terms = (shown.astype(np.uint64) + np.uint64(1)) * random_words(int(size.max()), seed)[at]
            terms[~word[self.start[0] :]] = 0
            self.hash = mix(np.add.reduceat(terms, self.start - self.start[0]))
        else:
            self.hash = np.zeros(0, np.uint64)


def as_batches(frame: dict[str, np.ndarray | pa.Array | list], schema: pa.Schema, rows: int = 65536) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows."""
    arrays = [frame[f.name] if isinstance(frame[f.name], pa.Array) else pa.array(frame[f.name], type=f.type) for f in schema]
    whole = pa.RecordBatch.from_arrays(arrays, schema=schema)
    for i in range(0, max(1, whole.num_rows), rows):
        yield whole.slice(i, rows)
