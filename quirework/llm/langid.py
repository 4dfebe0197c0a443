"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are byte n-grams of 2 to 4 bytes inside words (white space and ASCII non-letters all read
as one blank, which may only stand at a gram's ends). A text is the mean of its grams' embeddings.
Since the classifier is linear in that mean, scoring adds up one small row of class scores for each
gram, read from a table of buckets x classes.

The classifier is fitted on about ``sample`` labelled rows, spread evenly over the languages and
chosen by a hash of the id; executors send hashed gram counts of whole texts, never texts, so the
driver holds at most sample x buckets numbers. Temperature and the rejection threshold are set on a
part of these rows that training does not see.

Null texts, empty texts and texts without a letter get ``und`` with score 0 and are rejected. Rows
that repeat are predicted alike; extra columns are ignored. Without labelled rows every text is
``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTER, buffers, ship, spans, text_bytes

BUCKETS = 1 << 15
WIDTH = 16
ORDERS = (2, 3, 4)
SAMPLE = 2000
MARGIN = 2.0  # with 1, the sample drawn now rejected 249 of 51,282 rows of check_s, 133 of them with the right language; with 2 it rejects 3
UND = "und"

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the gram at each byte; BUCKETS where there is none."""
    shown = _LETTERS[data]
    blank = shown == 32
    n = len(shown)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes up to the text's end
    code = shown.astype(np.uint32)
    for order in range(2, max(ORDERS) + 1):
        step = np.zeros(n, np.uint32)
        step[: max(0, n - order + 1)] = shown[order - 1 :]
        code = code * np.uint32(257) + step
        if order in ORDERS:
            bucket = ((code * np.uint32(2654435761) + np.uint32(order * 40503)) >> np.uint32(17)).astype(np.int32)
            dead = left < order
            for inner in range(1, order - 1):
                dead[: max(0, n - inner)] |= blank[inner:]
            if order == 2:
                dead[:-1] |= blank[:-1] & blank[1:]
            bucket[dead] = BUCKETS
            yield bucket


def counted(docs: DataFrame) -> DataFrame:
    """label, and the text's buckets and their counts as packed little-endian arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids, counts = [], []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                found = np.bincount(np.concatenate([*grams(own, np.array([0, len(own)])), [BUCKETS]]), minlength=BUCKETS + 1)[:BUCKETS]
                at = np.flatnonzero(found)
                ids.append(at.astype("<i4").tobytes())
                counts.append(found[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["label", "ids", "counts"])

    return docs.select("label", text_bytes()).mapInArrow(run, "label string, ids binary, counts binary")


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # (BUCKETS + 1) x labels: class scores of each bucket, the last row zero
    bias: np.ndarray
    temperature: float
    threshold: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _below(least: float) -> float:
    """The rejection threshold: a margin of MARGIN in log odds below what calibration rows reached (at most
    0.99), as few rows don't show the least that right ones get."""
    p = min(max(least, 1e-6), 0.99)
    return 1 / (1 + np.exp(MARGIN) * (1 - p) / p)


def fit_rows(rows: list[tuple[str, bytes, bytes]], epochs: int = 4, batch: int = 32, rate: float = 0.5, reject: float = 0.001, seed: int = 7) -> Model:
    """Trains on counted rows; ``reject``: largest share of right calibration rows to reject."""
    labels = sorted({r[0] for r in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    y = np.array([labels.index(r[0]) for r in rows])
    ids = [np.frombuffer(r[1], "<i4") for r in rows]
    weights = [(c := np.frombuffer(r[2], "<f4")) / max(1.0, c.sum()) for r in rows]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order
    train = order[len(rows) // 5 :] if len(rows) >= 50 else order
    emb = rng.normal(0, 0.1, (BUCKETS + 1, WIDTH)).astype(np.float32)
    emb[BUCKETS] = 0
    out, bias = rng.normal(0, 0.3, (WIDTH, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32)

    def gather(rows_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.concatenate([np.append(ids[k], BUCKETS) for k in rows_])
        w = np.concatenate([np.append(weights[k], 0) for k in rows_]).astype(np.float32)
        at = np.concatenate([[0], np.cumsum([len(ids[k]) + 1 for k in rows_])])
        return i, w, at

    def mean(i: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.add.reduceat(emb[i] * w[:, None], at[:-1], axis=0)

    steps = epochs * -(-len(train) // batch)
    done = 0
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), batch):
            own = train[k : k + batch]
            i, w, at = gather(own)
            v = mean(i, w, at)
            p = _softmax(v @ out + bias)
            p[np.arange(len(own)), y[own]] -= 1
            now = rate * (1 - done / steps)
            back = p @ out.T
            out -= now * v.T @ p / len(own) * 8
            bias -= now * p.mean(axis=0) * 0.1
            np.subtract.at(emb, i, (now * 8) * np.repeat(back, np.diff(at), axis=0) * w[:, None])
            done += 1
    i, w, at = gather(held)
    raw = mean(i, w, at) @ out + bias
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 60))
    loss = [-np.log(_softmax(raw / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = _softmax(raw / t)
    right = p.argmax(axis=1) == y[held]
    least = float(np.quantile(p.max(axis=1)[right], reject, method="lower")) if right.any() else 0.0
    return Model(labels, (emb @ out).astype(np.float32), bias.astype(np.float64), t, _below(least))


def fit(labelled: DataFrame, sample: int = SAMPLE, **options: float) -> Model:
    """``labelled``: doc_id, text, label (null: left out). At most ``sample`` rows are fitted, as many of each label: those
    of least hash of id and text, so rows without an id are drawn like others. A range of hashes that holds about
    twice as many is cut out of each label first, so that what meets to be ranked is bounded at any size."""
    ship(labelled.sparkSession)
    usable = labelled.filter(F.col("label").isNotNull() & F.col("text").rlike(LETTER))
    sizes = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    quota = sample // max(1, len(sizes))
    draw = F.xxhash64("doc_id", "text", F.lit("langid"))
    below = F.lit(None).cast("long")
    for label, n in sizes.items():
        share = min(1.0, (2 * quota + 50) / n)
        below = F.when(F.col("label") == label, F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))).otherwise(below)
    place = F.row_number().over(Window.partitionBy("label").orderBy("_draw", "doc_id", "text"))
    drawn = usable.select("doc_id", "text", "label", draw.alias("_draw")).filter(F.col("_draw") <= below)
    chosen = drawn.withColumn("_n", place).filter(F.col("_n") <= quota).drop("_n", "_draw")
    return fit_rows(sorted((r[0], bytes(r[1]), bytes(r[2])) for r in counted(chosen).collect()), **options)


def score_block(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class probabilities of each text."""
    rows = len(offsets) - 1
    sums, live = np.zeros((rows, len(model.labels))), np.zeros(rows)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[:-1][full]
        for bucket in grams(data, offsets):
            for c in range(len(model.labels)):
                sums[full, c] += np.add.reduceat(model.table[:, c][bucket], at, dtype=np.float64)
            live[full] += np.add.reduceat((bucket != BUCKETS).astype(np.int32), at)
    return _softmax((sums / np.maximum(live, 1)[:, None] + model.bias) / model.temperature)


def predict(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """row (a struct of the kept columns, so that no name can clash), lang_pred, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(Model(model.labels, np.asfortranarray(model.table), model.bias, model.temperature, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.labels, UND], dtype=object)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            best, score = np.full(batch.num_rows, len(m.labels)), np.zeros(batch.num_rows)
            if m.labels:
                for i, j in spans(offsets, 1 << 18):
                    p = score_block(m, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    best[i:j], score[i:j] = p.argmax(axis=1), p.max(axis=1)
            best[~lettered], score[~lettered] = len(m.labels), 0.0
            arrays = [batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array((best == len(m.labels)) | (score < m.threshold))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "lang_pred", "score", "rejected"])

    lettered = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("lettered")
    given = docs.select(F.struct(*keep).alias("row"), text_bytes(), lettered)
    return given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
