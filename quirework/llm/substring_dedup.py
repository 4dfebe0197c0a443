"""Substring dedup: windows of words that stand in earlier text, in place of a relative Lempel-Ziv parse.

Documents are read as words. Nothing is parsed greedily: windows of ``LENGTH`` words that repeat are
found by anchors, as in suffix_dedup, and a factor is a maximal run of words that such windows cover.

The reference is all documents, earlier first, indexed in blocks: a block is one partition of the
anchors' fingerprints (see anchors), so a phrase meets every earlier place that could hold it in
exactly one block. Phrases are looked up longest first: the whole neighbourhood of an anchor, which
settles the inside of a factor with one lookup; where two factors meet, or a factor ends, no whole
neighbourhood is found, and the windows of ``LENGTH`` words across the boundary are looked up one by
one. So windows that a purely greedy parse would split between two factors are found too.

A window is removed if its words also start earlier: in a smaller doc_id, or in the same document
further left. Rows with the same doc_id and the same start are ties, neither is earlier; a null
doc_id comes before all others. Null text has no words. Words are runs of bytes outside white space,
unchanged. Texts of any length are worked through in blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .anchors import Shape, word_symbols

LENGTH = 20
SHAPE = Shape(length=LENGTH, reach=14, k=7)


def _figures(text: bytes) -> tuple[int, str]:
    words = text.split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def factors(n: int, runs: list[dict], single: list[int]) -> list[tuple[int, int]]:
    """(first word, words) of each maximal stretch all of whose words lie in repeated windows."""
    gone = np.concatenate([[False], repeats.covered(n, LENGTH, runs, single), [False]])
    edges = np.flatnonzero(gone[1:] != gone[:-1])
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _cut(text: bytes, runs: list[dict], single: list[int]) -> tuple[int, int, str, str]:
    words = text.split()
    found, kept, at = factors(len(words), runs, single), [], 0
    for start, n in found:
        kept += words[at:start]
        at = start + n
    left = b" ".join(kept + words[at:])
    return sum(n for _, n in found), len(found), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    all_docs, touched, singles = repeats.find(docs, "substring", word_symbols, SHAPE, 1, True, _figures)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("gone", pa.int64()), ("n_spans", pa.int64()), ("kept_sha", pa.string()), ("kept", pa.string())])
    ddl = "doc_id long, text_key long, gone long, n_spans long, kept_sha string, kept string"
    return all_docs, repeats.apply_cuts(touched.df, singles, _cut, ddl, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and n_spans."""
    all_docs, cuts = _found(docs)
    both = repeats.with_cuts(all_docs, cuts.drop("kept"))
    return both.select("doc_id", F.col("size").alias("n_words"), F.coalesce("gone", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id and text (kept words joined by a blank) of every document."""
    _, cuts = _found(docs)
    cut = cuts.dropDuplicates(repeats.KEY)
    given = docs.select(F.col("doc_id").cast("long"), repeats.text_key(), "text")
    return given.join(cut, repeats.same_row(given, cut), "left").select(given["doc_id"], F.coalesce("kept", "text").alias("text"))
