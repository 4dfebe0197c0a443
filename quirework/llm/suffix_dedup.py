"""Suffix-array dedup: distributed prefix doubling over positions, byte by byte exact.

A suffix array puts positions with long common prefixes side by side. Prefix doubling builds it in
rounds: positions are ranked by their first h bytes, then by the pair (rank here, rank h further on),
which ranks them by 2h bytes. Here (``doubled``):

1. Round 0 sorts all distinct stretches of h bytes that occur more than once, at positions p and p + h
   alike; a stretch's rank is its place in that sort. Stretches are named by 64-bit fingerprints, so the
   order is that of the names; dedup needs ties, not the alphabet.
2. The next round sorts the distinct pairs (rank at p, rank at p + h) that occur more than once and
   reranks. A position whose stretch or pair is unique leaves at once.
3. What is still tied past the threshold is told apart by its whole neighbourhood (128 bits).

Every round aggregates before it sorts, so a hot stretch is one row there.

Ranked positions are anchors (see anchors): of every ``length``-byte string one position among its
first 101 that depends on its content alone. A string repeats only if its anchor stays tied to the end.

Every byte covered by a ``length``-byte string that also starts anywhere else (same document
included; overlaps count) is removed; with ``keep_first`` one that also starts earlier (smaller doc_id,
or same document, further left), so the first copy stays. Null text is empty. Repeated rows are
documents of their own, so they remove each other (with ``keep_first`` rows of equal doc_id are ties,
neither is earlier). Texts of any length are worked through in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats
from .anchors import Shape, byte_symbols
from .common import Stage, ship

LENGTH = 400
REACH = 101


def _figures(text: bytes) -> tuple[int, str]:
    return len(text), hashlib.sha256(text).hexdigest()


def rerank(pairs: DataFrame, names: list[str], *more: Column) -> Stage:
    """``names`` of each distinct row that occurs more than once, and its ``rank``: its place in the sort."""
    again = pairs.groupBy(*names).agg(F.count("*").alias("n"), *more).filter("n > 1")
    return Stage(again.orderBy(*names).withColumn("rank", F.monotonically_increasing_id()).drop("n"), "suffix-ranks")


def doubled(runs: DataFrame) -> tuple[DataFrame, list[Stage]]:
    """Runs whose first 2h bytes are tied with another's, ``tie`` being their rank; ``mixed`` where the
    whole neighbourhood differs among them. ``key0`` and ``key1`` name the bytes at p and at p + h."""
    stretches = runs.select(F.explode(F.array("key0", "key1")).alias("key"))
    single = rerank(stretches, ["key"])
    here, further = (single.df.select(F.col("key").alias(f"key{i}"), F.col("rank").alias(f"rank{i}")) for i in (0, 1))
    ranked = Stage(runs.join(here, "key0").drop("key0").join(further, "key1").drop("key1"), "suffix-ranked")
    single.drop()
    double = rerank(ranked.df, ["rank0", "rank1"], F.min("e1").alias("lo"), F.max("e1").alias("hi"))
    pairs = double.df.select("rank0", "rank1", F.col("rank").alias("tie"), (F.col("lo") != F.col("hi")).alias("mixed"))
    return ranked.df.join(pairs, ["rank0", "rank1"]), [ranked, double]


def _cuts(length: int) -> Callable[[bytes, list[dict], list[int]], tuple]:
    def cut(text: bytes, runs: list[dict], single: list[int]) -> tuple[int, int, str, str]:
        gone = repeats.covered(len(text), length, runs, single)
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        return int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")

    return cut


def _found(docs: DataFrame, length: int, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    ship(docs.sparkSession)
    shape = Shape(length=length, reach=REACH, k=24)
    all_docs, touched, singles = repeats.find(docs, "suffix", byte_symbols, shape, 2, keep_first, _figures, doubled)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("gone", pa.int64()), ("n_spans", pa.int64()), ("kept_sha", pa.string()), ("kept", pa.string())])
    ddl = "doc_id long, text_key long, gone long, n_spans long, kept_sha string, kept string"
    return all_docs, repeats.apply_cuts(touched.df, singles, _cuts(length), ddl, schema)


def report(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    all_docs, cuts = _found(docs, length, keep_first)
    both = repeats.with_cuts(all_docs, cuts.drop("kept"))
    return both.select(
        "doc_id", F.col("size").alias("n_bytes"), F.coalesce("gone", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256")
    )


def dedup(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """``docs`` with repeated stretches cut from ``text``; a character cut in two goes altogether, and
    ``n_chars``, where there is one, follows the text. A null text stays null."""
    _, cuts = _found(docs, length, keep_first)
    kept = cuts.dropDuplicates(repeats.KEY).select(F.col("doc_id").alias("_cut_doc"), F.col("text_key").alias("_cut_key"), "kept", F.lit(True).alias("_cut"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_doc"), repeats.text_key())
    both = row.join(kept, row["_doc"].eqNullSafe(kept["_cut_doc"]) & (row["text_key"] == kept["_cut_key"]), "left")
    text = F.when(F.col("_cut"), F.col("kept")).otherwise(F.col("row.text"))
    fields = {c: F.col(f"row.`{c}`") for c in docs.columns}
    fields["text"] = text
    if "n_chars" in fields:
        fields["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return both.select(*[v.alias(c) for c, v in fields.items()])
