"""Which windows repeat, over all documents: the exchanges behind suffix-array and substring dedup.

1. ``run_keys``: a fingerprint of the leading stretch of every run (see anchors), each once for a batch
   of texts; those that occur again make a bitmap of fixed size.
2. ``scan``: reads the texts once more and writes the runs that the bitmap lets through, with one row
   of figures for each document, to the shared folder.
3. ``narrow`` keeps runs whose leading stretch occurs again (``suffix_dedup`` ranks it by doubling instead).
4. ``settle``: runs equal as a whole are settled at once; of those with the same leading stretch but
   different surroundings one of each kind stays open.
5. ``open_windows``: the windows of open runs are compared one by one, by a bitmap first again.

Counts are summed before they travel, and what is joined back is unique in its key and written first,
so a passage in a third of all documents makes one large side that Spark may split (it can't where an
aggregate feeds the join), never a group in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import Shape, Symbols, each_run, window_prints
from .common import Stage, buffers, in_bits, key_batch, release_shuffles, repeated_bits, text_bytes, text_key

Kept = tuple[int, int, int, bytes, bytes]  # removed symbols, spans, symbols, kept bytes, all bytes
KEY = ["doc_id", "text_key"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_key(), text_bytes())


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def run_keys(docs: DataFrame, symbols_of: Symbols, shape: Shape, shares: int) -> DataFrame:
    """The first key of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            yield key_batch(np.concatenate([np.zeros(0, np.uint64), *(r.keys[0] for r in each_run(data, offsets, symbols_of, shape, shares))]))

    return docs.select(text_bytes()).mapInArrow(run, "key long")


def scan(docs: DataFrame, symbols_of: Symbols, shape: Shape, shares: int, figures: Callable[[bytes], tuple[int, str]], bits: np.ndarray) -> DataFrame:
    """Rows of runs whose first key is in ``bits``, and for each document one with ``size`` and ``sha`` (of
    it all), whose pos is null."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    names = ["doc_id", "text_key", "pos", "windows", *(f"key{i}" for i in range(shares)), "e1", "e2", "size", "sha"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * (shares + 2), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column(0), batch.column(1)
            measured = [figures(t.as_py()) for t in batch.column(2)]
            none = [pa.nulls(batch.num_rows, t) for t in kinds[2:-2]]
            yield pa.RecordBatch.from_arrays([doc, key, *none, pa.array([m[0] for m in measured], pa.int64()), pa.array([m[1] for m in measured], pa.string())], schema=schema)
            data, offsets = buffers(batch.column(2))
            for r in each_run(data, offsets, symbols_of, shape, shares):
                pick = np.flatnonzero(in_bits(held.value, r.keys[0]))
                if not len(pick):
                    continue
                row = pa.array(r.row[pick])
                found = [pa.array(x[pick].view(np.int64)) for x in (*r.keys, *r.whole)]
                yield pa.RecordBatch.from_arrays([doc.take(row), key.take(row), pa.array(r.start[pick], pa.int32()), pa.array(r.windows[pick], pa.int32()), *found, pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.string())], schema=schema)

    ddl = ", ".join(f"{n} {'string' if pa.types.is_string(t) else 'int' if t == pa.int32() else 'long'}" for n, t in zip(names, kinds, strict=True))
    return keyed(docs).mapInArrow(run, ddl)


Ties = Callable[[DataFrame], tuple[DataFrame, list[Stage]]]


def narrow(runs: DataFrame) -> tuple[DataFrame, list[Stage]]:
    """Runs whose ``key0`` occurs more than once, as ``tie``; ``mixed`` where their whole stretch differs.
    And the tables to drop once the runs are written."""
    again = runs.groupBy("key0").agg(F.count("*").alias("n"), F.min("e1").alias("lo"), F.max("e1").alias("hi"))
    again = Stage(again.filter("n > 1").select("key0", (F.col("lo") != F.col("hi")).alias("mixed")), "repeats-ties")
    return runs.join(again.df, "key0").withColumnRenamed("key0", "tie"), [again]


def settle(runs: DataFrame, earlier: bool) -> tuple[DataFrame, list[Stage]]:
    """``whole``: all windows of the run repeat; ``open``: its windows must be looked at one by one.

    ``earlier``: a window counts as repeated only if it also starts before, by (doc_id, position).
    And the tables to drop once the runs are written.
    """
    kinds = runs.groupBy("e1", "e2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "text_key")).alias("first"))
    kinds = Stage(kinds.filter("n > 1").select("e1", "e2", "n", F.col("first.doc_id").alias("d"), F.col("first.pos").alias("p"), F.col("first.text_key").alias("k")), "repeats-kinds")
    found = runs.join(kinds.df, ["e1", "e2"], "left")
    leads = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("pos") == F.col("p")) & (F.col("text_key") == F.col("k"))
    if earlier:
        whole = F.col("n").isNotNull() & (F.struct("doc_id", "pos") > F.struct("d", "p"))
        opened = F.col("mixed") & ~whole
    else:
        whole = F.col("n").isNotNull()
        opened = F.col("mixed") & (leads | ~whole)
    return found.select(*KEY, "pos", "windows", whole.alias("whole"), opened.alias("open")).filter("whole or open"), [kinds]


def open_windows(touched: DataFrame, symbols_of: Symbols, length: int, bits: np.ndarray | None) -> DataFrame:
    """Without ``bits`` one fingerprint, ``key``, of every window of every open run; with them a row with
    two fingerprints for each window that they hold."""
    held = touched.sparkSession.sparkContext.broadcast(bits)

    def windows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, key, text, runs in zip(*batch.columns, strict=True):
            own = [r for r in runs.as_py() if r["open"]]
            if own:
                data = np.frombuffer(text.as_py(), np.uint8)
                symbols, _ = symbols_of(data, np.array([0, len(data)]))
                starts = np.concatenate([np.arange(r["pos"], r["pos"] + r["windows"]) for r in own])
                yield doc.as_py(), key.as_py(), starts, *window_prints(symbols, starts, length)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield key_batch(np.concatenate([np.zeros(0, np.uint64), *(w[3] for w in windows(batch.slice(at, 1000)))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, starts, w1, w2 in windows(batch):
                pick = np.flatnonzero(in_bits(held.value, w1))
                n = len(pick)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(starts[pick], pa.int32()), pa.array(w1[pick].view(np.int64)), pa.array(w2[pick].view(np.int64))],
                        names=["doc_id", "text_key", "pos", "w1", "w2"],
                    )

    if bits is None:
        return touched.mapInArrow(keys, "key long")
    return touched.mapInArrow(run, "doc_id long, text_key long, pos int, w1 long, w2 long")


def repeated_windows(windows: DataFrame, earlier: bool) -> DataFrame:
    """For each document the starts of open windows that repeat."""
    kinds = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).filter("n > 1")
    found = windows.join(kinds, ["w1", "w2"])
    if earlier:
        found = found.filter(F.struct("doc_id", "pos") > F.col("first"))
    return found.groupBy(*KEY).agg(F.collect_set("pos").alias("single"))


def covered(n: int, length: int, runs: list[dict], single: list[int]) -> np.ndarray:
    """Which of n symbols lie in a repeated window."""
    edge = np.zeros(n + 1, np.int32)
    for r in runs:
        if r["whole"]:
            edge[r["pos"]] += 1
            edge[r["pos"] + r["windows"] - 1 + length] -= 1
    at = np.asarray(single, np.int64)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, at + length, 1)
    return np.cumsum(edge[:-1]) > 0


def apply_cuts(touched: DataFrame, singles: DataFrame, cut: Callable[[bytes, list[dict], list[int]], tuple], ddl: str, schema: pa.Schema) -> DataFrame:
    """``cut`` gives the columns after the key for each touched document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d.as_py(), k.as_py(), *cut(t.as_py(), r.as_py(), s.as_py() or [])) for d, k, t, r, s in zip(*batch.columns, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    s = singles.hint("shuffle_hash")
    joined = touched.join(s, same_row(touched, s), "left").select(touched["doc_id"], touched["text_key"], "text", "runs", "single")
    return joined.mapInArrow(run, ddl)


def find(
    docs: DataFrame, label: str, symbols_of: Symbols, shape: Shape, shares: int, earlier: bool, figures: Callable[[bytes], tuple[int, str]], ties: Ties = narrow
) -> tuple[DataFrame, Stage, DataFrame]:
    """(figures of every document, touched documents with their runs, starts of single windows)."""
    spark = docs.sparkSession
    bits = repeated_bits(run_keys(docs, symbols_of, shape, shares))
    release_shuffles(spark)
    scanned = Stage(scan(docs, symbols_of, shape, shares, figures, bits), f"{label}-runs")
    runs = scanned.df.filter("pos is not null").drop("size", "sha")
    all_docs = Stage(scanned.df.filter("pos is null").select(*KEY, "size", "sha"), f"{label}-documents")
    tied, done = ties(runs)
    tied = Stage(tied.select(*KEY, "pos", "windows", "e1", "e2", "mixed"), f"{label}-tied")
    for stage in (scanned, *done):
        stage.drop()
    release_shuffles(spark)
    settled, done = settle(tied.df, earlier)
    settled = Stage(settled, f"{label}-settled")
    for stage in (tied, *done):
        stage.drop()
    release_shuffles(spark)
    per = settled.df.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "windows", "whole", "open")).alias("runs"))
    given, per = keyed(docs), per.hint("shuffle_hash")
    touched = Stage(given.join(per, same_row(given, per)).select(given["doc_id"], given["text_key"], "text", "runs"), f"{label}-touched")
    settled.drop()
    release_shuffles(spark)
    bits = repeated_bits(open_windows(touched.df, symbols_of, shape.length, None))
    release_shuffles(spark)
    windows = Stage(open_windows(touched.df, symbols_of, shape.length, bits), f"{label}-windows")
    return all_docs.df, touched, repeated_windows(windows.df, earlier)


def with_cuts(all_docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Every document's figures beside what was cut, if anything."""
    cuts = cuts.dropDuplicates(KEY)
    return all_docs.join(cuts, same_row(all_docs, cuts), "left").drop(cuts["doc_id"]).drop(cuts["text_key"])
