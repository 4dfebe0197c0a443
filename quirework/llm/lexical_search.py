"""Ranked lexical search: a dual-sorted wavelet tree for each shard of documents, searched best first.

1. ``totals`` counts the documents with terms and all their terms.
2. ``build_index`` cuts the documents, as they are read, into shards of at most about ``SHARD_TOKENS`` terms
   and writes each as one row: ids, dictionary, impacts and the bits of its tree (wavelet.py). Nothing is
   exchanged; a lost executor costs its shards.
3. ``search`` takes document frequencies from the dictionaries, then every task goes through its shards
   and carries the best k of each query from one to the next as threshold; a window takes the best k of
   all tasks. Queries are broadcast in parts of at most ``most_bytes`` of text (checked), a pass each.

The score is integer arithmetic as its formula says: for each term of the query, repeats included,
floor(1000 ln((2N + 2) / (2 df + 1))) * ((10^9 tf) div (1000 tf + 8 m)), m = 25 + (75 n N) div L.
Terms are runs of letters and digits of ASCII and of any character beyond it, A-Z lower-cased, told apart by
64-bit fingerprints.

Null and empty texts hold no term and are never found; a query without terms, or whose terms no document
holds, gives no rows. Rows that repeat are documents of their own, and a null doc_id comes after all others
on equal scores. Queries that are equal in id and text are one. Empty tables give no rows. Further columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Stage, buffers, ship, spans, text_bytes
from .toxicity import _INSIDE, tokens_of
from .wavelet import LAST, Best, Packed, Tree, pack, search as search_tree

K = 10
SHARD_TOKENS = 1 << 21
SHARD_DOCS = 1 << 14
CHUNK = 1 << 20
MOST_BYTES = 16 << 20
INDEX = "n_docs int, unnamed int, ids binary, terms binary, at binary, impact binary, bits binary"


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_bytes())


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many terms each text has."""
    begins = _INSIDE[data]
    before = np.append(False, begins[:-1])
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    return np.diff(np.append(0, np.cumsum(begins & ~before))[offsets])


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents that have terms, all their terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            counts = [term_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in spans(offsets, CHUNK)]
            own = np.concatenate([np.zeros(0, np.int64), *counts])
            yield pa.RecordBatch.from_arrays([pa.array([int((own > 0).sum())]), pa.array([int(own.sum())])], names=["docs", "terms"])

    ship(docs.sparkSession)
    row = docs.select(text_bytes()).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def _shard(parts: list[tuple[np.ndarray, np.ndarray]], counts: list[int], ids: list[int | None], n_docs: int, n_terms: int) -> Packed:
    """``parts``: fingerprints and rows of tokens; rows count up as ``counts`` and ``ids`` do."""
    h, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    held = np.flatnonzero(np.array(counts))
    unnamed = sum(ids[i] is None for i in held)
    key = np.array([LAST if ids[i] is None else ids[i] for i in held], np.int64)
    order = np.lexsort((np.array([ids[i] is None for i in held]), key))
    local = np.zeros(len(counts), np.int64)
    local[held[order]] = np.arange(len(held))
    norm = np.array([25 + 75 * counts[i] * n_docs // n_terms for i in held[order]], np.int64)
    row = local[row]
    by_term = np.lexsort((row, h))
    h, row = h[by_term], row[by_term]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
    tf = np.diff(np.append(first, len(h)))
    return pack(h[first], row[first], tf, norm, key[order], unnamed)


def build_index(docs: DataFrame, n_docs: int, n_terms: int, shard_tokens: int = SHARD_TOKENS, chunk: int = CHUNK) -> Stage:
    """One row a shard; ``chunk`` bytes of text are read at a time. ``n_docs`` and ``n_terms``: the totals that impacts rest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        counts: list[int] = []
        ids: list[int | None] = []
        tokens = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal parts, counts, ids, tokens
            if tokens:
                p = _shard(parts, counts, ids, n_docs, n_terms)
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in (p.ids, p.terms, p.at, p.impact, p.bits)]
                yield pa.RecordBatch.from_arrays([pa.array([len(p.ids)], pa.int32()), pa.array([p.unnamed], pa.int32()), *blobs], names=["n_docs", "unnamed", "ids", "terms", "at", "impact", "bits"])
            parts, counts, ids, tokens = [], [], [], 0

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in spans(offsets, chunk):
                words = tokens_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append((words.hash, words.row + len(counts)))
                counts += words.count.tolist()
                ids += batch.column(0).slice(i, j - i).to_pylist()
                tokens += len(words.hash)
                if tokens >= shard_tokens or len(counts) >= SHARD_DOCS:
                    yield from emit()
        yield from emit()

    ship(docs.sparkSession)
    return Stage(_given(docs).mapInArrow(run, INDEX), "lexical-index", {"parquet.page.size.row.check.min": "1"})


def _unpacked(batch: pa.RecordBatch, row: int) -> Packed:
    n, unnamed, *blobs = (batch.column(c)[row].as_py() for c in range(7))
    ids, terms, at, impact, bits = (np.frombuffer(b, t) for b, t in zip(blobs, (np.int64, np.uint64, np.int32, np.int32, np.uint8), strict=True))
    levels = max(0, n - 1).bit_length()
    return Packed(ids, unnamed, terms, at, impact, bits.reshape(levels, -1) if levels else bits.reshape(0, 0))


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the sorted ``terms`` occurs."""
    held = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, at in zip(batch.column(0), batch.column(1), strict=True):
                own, at = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(at.as_py(), np.int32)
                k = np.searchsorted(own, held.value)
                hit = np.flatnonzero(own[np.minimum(k, len(own) - 1)] == held.value)
                yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array((at[k[hit] + 1] - at[k[hit]]).astype(np.int64))], names=["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for term, df in index.select("terms", "at").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).toLocalIterator():
        out[term] = df
    return out


def _pass(index: DataFrame, texts: list[bytes], n_docs: int, k: int) -> DataFrame:
    """query (place in ``texts``), doc_id, score: the best ``k`` of each task."""
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    words = tokens_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
    terms, place = np.unique(words.hash, return_inverse=True)
    df = frequencies(index, terms)
    value = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    pairs, times = np.unique(words.row * max(1, len(terms)) + place, return_counts=True)
    query, term = pairs // max(1, len(terms)), pairs % max(1, len(terms))
    weight = value[term] * times
    counts = (weight > 0) & (df[term] > 0)
    held = index.sparkSession.sparkContext.broadcast((query[counts], terms[term[counts]], weight[counts]))
    n = len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n, k)
        for batch in batches:
            for row in range(batch.num_rows):
                search_tree(Tree(_unpacked(batch, row)), *held.value, best)
        ids = pa.array(best.id, mask=best.id == LAST)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), ids, pa.array(best.score)], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = K, most_bytes: int = MOST_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the exact best ``k`` documents of each item."""
    spark = index.sparkSession
    ship(spark)
    named = StructType([StructField("query", LongType()), items.schema["item_id"]])
    found: DataFrame | None = None
    part: list[tuple] = []
    size = 0

    def look() -> None:
        nonlocal found, part, size
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(part)], named)
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = _pass(index, [bytes(r[1]) for r in part], n_docs, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        one = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        found = one if found is None else found.union(one)
        part, size = [], 0

    for row in items.select("item_id", text_bytes()).distinct().toLocalIterator():
        if part and size + len(row[1]) > most_bytes:
            look()
        part.append(row)
        size += len(row[1]) + 64
    if part or found is None:
        look()
    return found


def rank(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Indexes ``docs`` and ranks them for each of ``items``."""
    ship(docs.sparkSession)
    n_docs, n_terms = totals(docs)
    return search(build_index(docs, n_docs, n_terms).df, items, n_docs, k)


ORACLE = r"""
WITH low AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT row, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
size AS (SELECT row, doc_id, count(*)::BIGINT AS n FROM tok GROUP BY row, doc_id),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM size),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM tok GROUP BY row, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
items AS (SELECT DISTINCT item_id, text FROM benchmark),
ask AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM ask GROUP BY item_id, term),
scored AS (SELECT item_id, size.row, size.doc_id, sum(times * floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN size ON size.row = tf.row, total GROUP BY item_id, size.row, size.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
