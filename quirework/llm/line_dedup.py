"""Line dedup: sharded cuckoo filters backed by exact reference-count tables, reversible.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of fewer than
``LEAST`` code points are never dropped. Three tables hold the state:

- ``references``: a row for each key and document that holds it. It makes deletion exact.
- ``counts``: for each key the number of references and the least doc_id that holds it.
- ``filters``: for each shard of keys a cuckoo filter of those with two references or more, that is of the
  lines that may have to go. Insertions that lift a key to two references add it, deletions that bring it
  below remove it; a filter that overflows is built again from ``counts``.

Decisions go through the filters first: where all of them together stay below ``most_bytes`` (checked) they
are broadcast, and only lines they may hold travel to the exact counts; beyond that all lines travel. A
filter's false positives end there, so results never depend on it. A line is dropped unless its document
has the least doc_id of those that hold its key.

A hot line is summed up before it travels, and the join of lines with counts reads both sides from
exchanges that Spark can split. Documents come together with what they lose once, by id and text.

A null or empty text is one empty line. Rows of one doc_id are separate references, and all rows of
the least doc_id keep the line. A null doc_id counts as larger than all others; where only such rows
hold a line they keep it. Keys are told apart by 128 bits of BLAKE2. An empty table gives an empty one.
Further columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, ship, text_bytes, text_key
from .cuckoo import Cuckoo
from .repeats import keyed, same_row

LEAST = 10
SHARDS = 128
SHARD_KEYS = 1 << 20
MOST_BYTES = 64 << 20
EMIT = 1 << 18
KEY = ["hi", "lo"]
REFERENCE = "hi long, lo long, doc_id long, text_key long"
FILTER = "shard int, slots binary"


def line_key(line: bytes) -> bytes | None:
    """128 bits that name the line, or None if it is too short to be dropped."""
    key = line.strip().lower()
    if len(key) < LEAST or len(key) < 4 * LEAST and len(key.decode("utf-8", "replace")) < LEAST:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_references(docs: DataFrame) -> DataFrame:
    """hi, lo, doc_id, text_key: each key once a row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            own = pa.array(np.repeat(np.arange(len(counts)), counts))
            columns = [pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1]))]
            return pa.RecordBatch.from_arrays([*columns, *(batch.column(c).slice(start, len(counts)).take(own) for c in (0, 1))], names=["hi", "lo", "doc_id", "text_key"])

        for batch in batches:
            start, found, counts = 0, [], []
            for i, text in enumerate(batch.column(2)):
                keys = {line_key(x) for x in text.as_py().split(b"\n")} - {None}
                found += keys
                counts.append(len(keys))
                if len(found) >= EMIT:
                    yield emit()
                    start, found, counts = i + 1, [], []
            yield emit()

    return keyed(docs).mapInArrow(run, REFERENCE)


def shard_of(shards: int) -> Column:
    return F.pmod("lo", F.lit(shards)).cast("int")


def build_filters(shared: DataFrame, shards: int) -> DataFrame:
    """shard, slots: a cuckoo filter of the keys of each shard, about SHARD_KEYS at most."""

    def run(keys: pa.Table) -> pa.Table:
        own = Cuckoo.of(keys["hi"].to_numpy(), keys["lo"].to_numpy())
        return pa.table({"shard": keys["shard"].slice(0, 1).cast(pa.int32()), "slots": pa.array([own.slots.tobytes()], pa.binary())})

    return shared.select("hi", "lo", shard_of(shards).alias("shard")).groupBy("shard").applyInArrow(run, FILTER)


def change_filters(filters: DataFrame, changes: DataFrame, shards: int, added: bool) -> DataFrame:
    """Filters after ``changes`` (distinct keys); ``slots`` is null where a filter overflowed."""

    def run(old: pa.Table, keys: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return old
        hi, lo = keys["hi"].to_numpy(), keys["lo"].to_numpy()
        own = Cuckoo(np.frombuffer(old["slots"][0].as_py(), np.uint16).copy()) if old.num_rows else Cuckoo.sized(len(hi))
        fits = own.insert(hi, lo) if added else own.remove(hi, lo) is None
        return pa.table({"shard": keys["shard"].slice(0, 1).cast(pa.int32()), "slots": pa.array([own.slots.tobytes() if fits else None], pa.binary())})

    changed = changes.select("hi", "lo", shard_of(shards).alias("shard"))
    return filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInArrow(run, FILTER)


@dataclass
class LineStore:
    references: Stage  # hi, lo, doc_id, text_key
    counts: Stage  # hi, lo, refs, least
    filters: Stage  # shard, slots
    shards: int

    def drop(self) -> None:
        for stage in (self.references, self.counts, self.filters):
            stage.drop()


def _counted(references: DataFrame) -> DataFrame:
    return references.groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("doc_id").alias("least"))


def _fresh_filters(counts: DataFrame, least_shards: int) -> tuple[Stage, int]:
    shared = counts.filter("refs > 1")
    shards = max(least_shards, -(-shared.count() // SHARD_KEYS))
    return Stage(build_filters(shared, shards), "line-filters"), shards


def build(docs: DataFrame, shards: int = SHARDS) -> LineStore:
    """The state after all of ``docs``."""
    ship(docs.sparkSession)
    references = Stage(line_references(docs), "line-references")
    counts = Stage(_counted(references.df), "line-counts")
    filters, shards = _fresh_filters(counts.df, shards)
    return LineStore(references, counts, filters, shards)


def _changed(store: LineStore, references: DataFrame, counts: DataFrame, changes: DataFrame, added: bool) -> LineStore:
    """``store`` with new tables, its filters brought in line with ``changes`` (keys)."""
    held, counted = Stage(references, "line-references"), Stage(counts, "line-counts")
    filters = Stage(change_filters(store.filters.df, changes, store.shards, added), "line-filters")
    shards = store.shards
    if not filters.df.filter("slots IS NULL").isEmpty():
        over = filters.df.filter("slots IS NULL").select("shard")
        again = counted.df.filter("refs > 1").withColumn("shard", shard_of(shards)).join(F.broadcast(over), "shard", "left_semi")
        whole = Stage(filters.df.filter("slots IS NOT NULL").union(build_filters(again, shards)), "line-filters")
        filters.drop()
        filters = whole
    if counted.df.filter("refs > 1").count() > 2 * shards * SHARD_KEYS:
        filters.drop()
        filters, shards = _fresh_filters(counted.df, shards)
    return LineStore(held, counted, filters, shards)


def insert(store: LineStore, docs: DataFrame) -> LineStore:
    """The state with ``docs`` too; rows that it holds already (same id and text) are not counted again.
    The old state stays as it is."""
    ship(docs.sparkSession)
    known = store.references.df.select("doc_id", "text_key").distinct()
    given = line_references(docs)
    fresh = Stage(given.join(known, same_row(given, known), "left_anti"), "line-fresh")
    old = store.counts.df
    added = _counted(fresh.df)
    both = added.join(old.select(*KEY, F.col("refs").alias("was"), F.col("least").alias("had")), KEY, "left")
    touched = Stage(both.select(*KEY, (F.col("refs") + F.coalesce("was", F.lit(0))).alias("refs"), F.least("least", "had").alias("least"), F.coalesce("was", F.lit(0)).alias("was")), "line-touched")
    counts = old.join(touched.df, KEY, "left_anti").unionByName(touched.df.drop("was"))
    then = _changed(store, store.references.df.union(fresh.df), counts, touched.df.filter("was < 2 AND refs > 1"), True)
    fresh.drop()
    touched.drop()
    return then


def delete(store: LineStore, ids: DataFrame) -> LineStore:
    """The state without the documents whose ``doc_id`` is in ``ids``. The old state stays as it is."""
    ship(ids.sparkSession)
    wanted = ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
    is_gone = F.col("doc_id").eqNullSafe(F.col("gone"))
    held = store.references.df
    stay = Stage(held.join(wanted, is_gone, "left_anti"), "line-stay")
    keys = Stage(held.join(wanted, is_gone, "left_semi").select(*KEY).distinct(), "line-keys")
    recounted = Stage(_counted(stay.df.join(keys.df, KEY, "left_semi")), "line-recounted")
    old = store.counts.df
    counts = old.join(keys.df, KEY, "left_anti").unionByName(recounted.df)
    fell = old.filter("refs > 1").join(keys.df, KEY, "left_semi").join(recounted.df.filter("refs > 1"), KEY, "left_anti")
    then = _changed(store, stay.df, counts, fell, False)
    for stage in (stay, keys, recounted):
        stage.drop()
    return then


def maybe_shared(references: DataFrame, store: LineStore, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Those of ``references`` that the filters may hold; all of them if the filters are too large to broadcast."""
    if (store.filters.df.agg(F.sum(F.length("slots"))).first()[0] or 0) > most_bytes:
        return references
    shards = store.shards
    held = references.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["slots"]) for r in store.filters.df.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {shard: Cuckoo(np.frombuffer(slots, np.uint16)) for shard, slots in held.value.items()}
        for batch in batches:
            hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(hi), bool)
            order = np.argsort(shard := lo % shards, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows) and (filter_ := own.get(int(shard[rows[0]]))):
                    keep[rows] = filter_.holds(hi[rows], lo[rows])
            yield batch.filter(pa.array(keep))

    return references.mapInArrow(run, REFERENCE)


def dropped_keys(store: LineStore, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, text_key, gone: for each row that loses lines the keys of these."""
    asked = maybe_shared(store.references.df, store, most_bytes)
    shared = store.counts.df.filter("refs > 1 AND least IS NOT NULL").select(*KEY, "least")
    lost = asked.join(shared, KEY).filter(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    return lost.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*KEY)).alias("gone"))


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    lines, dropped, kept = [], [], []
    for text, keys in zip(texts, gone, strict=True):
        own = text.as_py().split(b"\n")
        lines.append(len(own))
        if keys.is_valid:
            packed = np.stack([keys.values.field(k).to_numpy() for k in (0, 1)], axis=1).tobytes()
            out = {packed[i : i + 16] for i in range(0, len(packed), 16)}
            own = [x for x in own if line_key(x) not in out]
        dropped.append(lines[-1] - len(own))
        kept.append(b"\n".join(own))
    return pa.StructArray.from_arrays([pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], names=["n_lines", "n_dropped", "kept"])


def without_dropped(store: LineStore, docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` (all of them in the store) as struct ``row``, and n_lines, n_dropped, kept (binary)."""
    gone = Stage(dropped_keys(store, most_bytes), "line-gone")
    given = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long"), text_key(), text_bytes())
    cut = F.arrow_udf(_without, "n_lines long, n_dropped long, kept binary")
    both = given.join(gone.df, same_row(given, gone.df), "left").select("row", cut(given["text"], "gone").alias("cut"))
    return both.select("row", "cut.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    store = build(docs)
    out = without_dropped(store, docs)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as text; a row that loses none keeps its text as it is."""
    store = build(docs)
    out = without_dropped(store, docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept").cast("string")).otherwise(F.col("row.text"))
    return out.select(*(text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


ORACLE = r"""
WITH lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT doc_id, i, line, least IS NOT NULL AND doc_id > least AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""
