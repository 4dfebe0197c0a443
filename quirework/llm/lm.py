"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(group | history) * P(class | group, history) * P(word | class).

Classes: the most frequent words and the end are classes of their own; all other words, known or
not, are classed by their spelling (last bytes), so any word has a class. Classes lie in GROUPS groups
of WIDTH. Both P(group | history) and P(class | group, history) are softmaxes of WIDTH scores that add
up hashed features of the history: the last word, the last two, and the words two and three back alone
(skips). So a token costs two short softmaxes instead of one over all classes. P(word | class) is the
maximum-entropy solution for indicator features of words in a class, which is their relative
frequency, smoothed by one with one place for unknown words as in the base.

Counts cover all training documents. Gradient updates are distributed: every block of documents
starts from the current weights, takes steps on its own training events, and the blocks' weights are
averaged row by row, weighted by how often each block saw the row, in a tree of partial sums. Round r
of ``rounds`` takes each ``rounds``-th token from the r-th on, so that together they take every token
of every training document once. Weights are BUCKETS x (GROUPS + 1) x WIDTH, whatever the input.

Word counts grow with the input and are never gathered in one place: documents stay in blocks, every
block asks for its distinct words only, and what comes back to it are the counts of words that other
blocks hold too.

Tokens are words (runs of bytes outside white space, A-Z lower-cased), then one end. Null and empty
texts have the end alone. Rows that repeat are counted and scored each on their own; a null doc_id
counts as empty text for the fold. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, Words, buffers, fold, mix, release_shuffles, spans, text_bytes

WIDTH = GROUPS = 16
CLASSES = GROUPS * WIDTH
OWN_CLASSES = 127  # words; the end comes next
SPELLED = CLASSES - OWN_CLASSES - 1
END_CLASS = OWN_CLASSES
BUCKETS = 1 << 13
FEATURES = 4
RANGES = 32
BLOCK_BYTES = 16 << 20
PIECE = 1 << 20
LEAST = 1e-20


def spelling(data: np.ndarray, words: Words) -> np.ndarray:
    """Class of each word by its last three bytes, A-Z lower-cased."""
    h = np.zeros(len(words.hash), np.uint64)
    for k in range(3):
        at = words.end - 1 - k
        b = np.where(at >= words.start, data[np.maximum(at, 0)], 0).astype(np.uint64)
        h = h * np.uint64(257) + np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
    return (mix(h) % np.uint64(SPELLED)).astype(np.int64) + OWN_CLASSES + 1


@dataclass
class Events:
    """The tokens of a block, an end after the words of each row."""

    row: np.ndarray
    word: np.ndarray  # fingerprint; 0 for the end
    klass: np.ndarray
    features: np.ndarray  # FEATURES x tokens, buckets
    first: np.ndarray  # of each row, and one more


def events_of(data: np.ndarray, offsets: np.ndarray, own: dict[str, np.ndarray], pick: slice = slice(None)) -> Events:
    """``pick``: which tokens get a row, a class and features; ``word`` and ``first`` cover all."""
    words = Words(data, offsets, lower=True)
    rows = words.rows
    total = len(words.hash) + rows
    first = words.at + np.arange(rows + 1)
    inner = np.ones(total, bool)
    inner[first[1:] - 1] = False
    word, klass = np.zeros(total, np.uint64), np.full(total, END_CLASS, np.int32)
    word[inner] = words.hash
    k = spelling(data, words)
    if len(own["word"]):
        slot = np.minimum(np.searchsorted(own["word"], words.hash), len(own["word"]) - 1)
        k = np.where(own["word"][slot] == words.hash, own["klass"][slot], k)
    klass[inner] = k
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(first))[pick]
    at = np.arange(total)[pick]
    place = at - first[row]
    back = [np.where(place >= d, word[np.maximum(at - d, 0)], np.uint64(d)) for d in (1, 2, 3)]
    feats = [back[0], mix(back[0] * np.uint64(3) + back[1]), back[1], back[2]]
    buckets = np.stack([(mix(f + np.uint64(1000 + i)) >> np.uint64(51)).astype(np.int16) for i, f in enumerate(feats)])
    return Events(row, word, klass[pick], buckets, first)


def rows_of(features: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two softmaxes for each token, first those of all groups, then those of all classes in them: rows of
    the weights (FEATURES x 2 tokens), rows of the bias, and which of WIDTH scores is right."""
    first = features.astype(np.int32) * (GROUPS + 1)
    group, inner = klass // WIDTH, klass % WIDTH
    return np.concatenate([first, first + 1 + group], axis=1), np.concatenate([np.zeros_like(group), 1 + group]), np.concatenate([group, inner])


def _exps(table: np.ndarray, bias: np.ndarray, rows: np.ndarray, own: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each softmax the exponentials of its scores, their sum, and the score of ``y``, all after the same shift.

    The largest score of the batch is taken off; where that leaves a softmax next to nothing, each one's own."""
    s = table.take(rows[0], axis=0)
    for r in rows[1:]:
        s += table.take(r, axis=0)
    s += bias.take(own, axis=0)
    s -= s.max(initial=-np.inf)
    right = s.ravel().take(np.arange(0, s.size, WIDTH) + y)
    e = np.exp(s)
    total = np.einsum("ij->i", e)
    if (total < LEAST).any():
        s -= s.max(axis=1, keepdims=True)
        right, e = s.ravel().take(np.arange(0, s.size, WIDTH) + y), np.exp(s)
        total = np.einsum("ij->i", e)
    return e, total, right


def log_class(table: np.ndarray, bias: np.ndarray, features: np.ndarray, klass: np.ndarray, batch: int = 2048) -> np.ndarray:
    """log P(class | history) of each token."""
    out = np.empty(len(klass))
    for i in range(0, len(klass), batch):
        rows, own, y = rows_of(features[:, i : i + batch], klass[i : i + batch])
        _, total, right = _exps(table, bias, rows, own, y)
        logp, n = right - np.log(total), len(y) // 2
        out[i : i + n] = logp[:n] + logp[n:]
    return out


def bias_of(n_class: np.ndarray) -> np.ndarray:
    """Log frequencies of groups, then of each group's classes."""
    n = (n_class + 0.5).reshape(GROUPS, WIDTH)
    return np.log(np.concatenate([(n.sum(axis=1) / n.sum())[None], n / n.sum(axis=1, keepdims=True)])).astype(np.float32)


def by_value(rows: np.ndarray) -> np.ndarray:
    """Stable order of row numbers, by their low and then their high half: 16 and 8 bits are counted, not compared."""
    low = np.argsort(rows.astype(np.uint16), kind="stable")
    return low[np.argsort((rows >> 16).astype(np.uint8)[low], kind="stable")]


def train_block(table: np.ndarray, bias: np.ndarray, seen: np.ndarray, features: np.ndarray, klass: np.ndarray, rate: float = 0.1, batch: int = 1024) -> None:
    """Gradient steps in place; ``seen`` counts how often each row was used."""
    for i in range(0, len(klass), batch):
        rows, own, y = rows_of(features[:, i : i + batch], klass[i : i + batch])
        p, total, _ = _exps(table, bias, rows, own, y)
        p /= total[:, None]
        p.ravel()[np.arange(0, p.size, WIDTH) + y] -= 1
        flat = rows.ravel()
        order = by_value(flat)
        placed = flat[order]
        at = np.flatnonzero(np.append(True, placed[1:] != placed[:-1]))
        uniq, n = placed[at], np.diff(np.append(at, len(placed)))
        # two scores at a time, as the real and the imaginary part: half as many sums to begin
        sums = np.add.reduceat(p.view(np.complex64).take(order % len(y), axis=0), at, axis=0).view(np.float32)
        often = seen.take(uniq) + n
        seen[uniq] = often
        now = table.take(uniq, axis=0)
        now -= (rate / np.sqrt(n * (1 + often / 50)))[:, None].astype(np.float32) * sums
        table[uniq] = now


def _blocks(docs: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """doc_id, held_out, text, and a block: the texts of one input task up to BLOCK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = buffers(batch.column(2))
            for i, j in spans(offsets, BLOCK_BYTES // 4):
                more = int(offsets[j] - offsets[i])
                if size and size + more > BLOCK_BYTES:
                    block, size = block + 1, 0
                size += more
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array([block] * (j - i), pa.int64()), *part.columns], names=["block", "doc_id", "held_out", "text"])

    given = docs.select(F.col("doc_id").cast("long"), (fold(modulus) == held_out).alias("held_out"), text_bytes())
    return given.mapInArrow(run, "block long, doc_id long, held_out boolean, text binary")


def _asks(blocks: DataFrame) -> DataFrame:
    """block, word, klass by spelling, n (in training documents): each distinct word of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(2))
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                # words of a piece at a time: those of a whole block take some fifty times its bytes
                found = []
                for p, q in spans(offsets[i : j + 1], PIECE):
                    own = data[offsets[i + p] : offsets[i + q]]
                    words = Words(own, offsets[i + p : i + q + 1] - offsets[i + p], lower=True)
                    word, first, where = np.unique(words.hash, return_index=True, return_inverse=True)
                    found.append((word, spelling(own, words)[first].astype(np.int32), np.bincount(where, ~held[i + p : i + q][words.row], minlength=len(word)).astype(np.int64)))
                every, klass, counts = (np.concatenate(x) for x in zip(*found, strict=True))
                word, first, where = np.unique(every, return_index=True, return_inverse=True)
                n, k = np.zeros(len(word), np.int64), klass[first]
                np.add.at(n, where, counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), block[i])), pa.array(word.view(np.int64)), pa.array(k), pa.array(n)], names=["block", "word", "klass", "n"])

    return blocks.select("block", "held_out", "text").mapInArrow(run, "block long, word long, klass int, n long")


def _sent(n: np.ndarray, moved: np.ndarray) -> bytes:
    """How often rows were used and how far they moved, the latter in half precision."""
    return n.astype(np.float32).tobytes() + moved.astype(np.float16).tobytes()


def _weighted(body: bytes) -> np.ndarray:
    """n and n x moved."""
    rows = len(body) // (4 + 2 * WIDTH)
    n = np.frombuffer(body, np.float32, rows)
    moved = np.frombuffer(body, np.float16, rows * WIDTH, 4 * rows).reshape(rows, WIDTH)
    return np.concatenate([n, (n[:, None] * moved).ravel()])


def _summed(parts: DataFrame, count: int) -> DataFrame:
    """Adds up ``count`` partial sums for each range, 32 at a time."""

    def adder(read: Callable[[bytes], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
        def add(table: pa.Table) -> pa.Table:
            total = sum(read(b) for b in table["body"].to_pylist())
            return pa.table({"range": table["range"][:1], "part": pa.array([table["part"][0].as_py()], pa.int64()), "body": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        return add

    read = _weighted
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / 32))
        parts = parts.groupBy("range", "part").applyInArrow(adder(read), "range int, part long, body binary")
        count, read = -(-count // 32), _plain
        if count <= 1:
            return parts


def _plain(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.float32)


def _round(blocks: DataFrame, table: np.ndarray, bias: np.ndarray, own: dict[str, np.ndarray], stride: int, phase: int, tasks: int) -> np.ndarray:
    held = blocks.sparkSession.sparkContext.broadcast((table, bias, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, b, mine = held.value
        start = start.reshape(-1, WIDTH)
        now, seen = start.copy(), np.zeros(len(start), np.int64)
        for batch in batches:
            learn = np.flatnonzero(~batch.column(0).to_numpy(zero_copy_only=False))
            data, offsets = buffers(batch.column(1).take(pa.array(learn)))
            for i, j in spans(offsets, 1 << 20):
                e = events_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], mine, slice(phase, None, stride))
                train_block(now, b, seen, e.features, e.klass)
        part = TaskContext.get().partitionId()
        width = len(start) // RANGES
        for r in range(RANGES):
            cut = slice(r * width, (r + 1) * width)
            body = _sent(seen[cut], now[cut] - start[cut])
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part], pa.int64()), pa.array([body], pa.binary())], names=["range", "part", "body"])

    parts = blocks.select("held_out", "text").mapInArrow(run, "range int, part long, body binary")
    out = table.reshape(-1, WIDTH).copy()
    width = len(out) // RANGES
    for r, _, body in _summed(parts, tasks).collect():  # RANGES rows of fixed size
        x = np.frombuffer(bytes(body), np.float32)
        n, s = x[:width], x[width:].reshape(width, -1)
        out[r * width : (r + 1) * width] += s / np.maximum(n, 1)[:, None]
    return out.reshape(table.shape)


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    blocks = Stage(_blocks(docs, modulus, held_out), "lm-blocks")
    asks = Stage(_asks(blocks.df), "lm-asks")
    counted = Stage(asks.df.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("blocks"), F.min("klass").alias("klass")), "lm-counts")
    counts = counted.df
    release_shuffles(spark)
    ends = blocks.df.filter(~F.col("held_out")).count()
    top = counts.filter("c > 0").orderBy(F.desc("c"), "word").limit(OWN_CLASSES).collect()
    own_words = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(own_words)
    own = {"word": own_words[order], "klass": order.astype(np.int64)}
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, n, v in counts.filter("c > 0").groupBy("klass").agg(F.sum("c"), F.count("*")).collect():
        n_class[k], v_class[k] = n, v
    for i, r in enumerate(top):
        n_class[r[3]] -= r[1]
        v_class[r[3]] -= 1
        n_class[i] = r[1]
    n_class[END_CLASS] = ends
    total, distinct = int(n_class.sum()), int(v_class.sum()) + len(top) + (1 if ends else 0)
    bias = bias_of(n_class)
    table = np.zeros((BUCKETS, (GROUPS + 1) * WIDTH), np.float32)
    tasks = blocks.df.rdd.getNumPartitions()
    if ends:
        for r in range(rounds):
            table = _round(blocks.df, table, bias, own, rounds, r, tasks)
    shared = counts.filter("blocks > 1").select("word", "c")
    answers = asks.df.select("block", "word").join(shared, "word").select("block", "word", "c")
    held = spark.sparkContext.broadcast((table, bias, own, n_class, v_class, total, distinct, ends))
    release_shuffles(spark)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t, b, mine, nk, vk, whole, v, n_ends = held.value
        known = np.concatenate([right["word"].to_numpy().view(np.uint64), np.zeros(1, np.uint64)])
        known_c = np.concatenate([right["c"].to_numpy(), [n_ends]])
        order_ = np.argsort(known)
        known, known_c = known[order_], known_c[order_]
        hold = left["held_out"].to_numpy(zero_copy_only=False)
        text = left["text"].combine_chunks()
        data, offsets = buffers(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
        pieces = [events_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], mine) for i, j in spans(offsets, 1 << 20)]
        starts = [i for i, _ in spans(offsets, 1 << 20)]
        # words that no other block holds are counted here
        word = np.concatenate([e.word for e in pieces])
        learn = np.concatenate([~hold[i + e.row] for i, e in zip(starts, pieces, strict=True)])
        local, where = np.unique(word, return_inverse=True)
        c = np.bincount(where, learn, minlength=len(local)).astype(np.int64)
        slot = np.minimum(np.searchsorted(known, local), len(known) - 1)
        c = np.where(known[slot] == local, known_c[slot], c)[where]
        out, at = [np.zeros(left.num_rows) for _ in range(4)], 0
        for i, e in zip(starts, pieces, strict=True):
            own_c, rows = c[at : at + len(e.word)], slice(i, i + len(e.first) - 1)
            at += len(e.word)
            base = np.log10((own_c + 1) / (whole + v + 1))
            logp = log_class(t.reshape(-1, WIDTH), b, e.features, e.klass)
            spelled = e.klass > END_CLASS
            inner = np.where(spelled, np.log10((own_c + 1) / (nk[e.klass] + vk[e.klass] + 1)), 0.0)
            out[0][rows] = np.diff(e.first)
            out[1][rows] = np.add.reduceat((own_c > 0).astype(np.int64), e.first[:-1])
            out[2][rows] = np.add.reduceat(base, e.first[:-1])
            out[3][rows] = np.add.reduceat(logp / np.log(10) + inner, e.first[:-1])
        arrays = {"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": pa.array(out[0].astype(np.int64)), "n_known": pa.array(out[1].astype(np.int64)), "train_tokens": pa.array(np.full(left.num_rows, whole)), "base_score": pa.array(out[2]), "score": pa.array(out[3])}
        return pa.table(arrays)

    return blocks.df.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
