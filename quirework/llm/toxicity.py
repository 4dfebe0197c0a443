"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals score documents.

Tokens are runs of letters, digits and non-ASCII bytes. Labels say only which documents are toxic, so
tokens are labelled first: a word or stem is suspect if it stands in many different contexts in toxic
documents and hardly in others (contexts, not documents, so that copies of one text count once); in
toxic documents tokens with a suspect word or stem are tagged 1, all else is tagged 0.

The field has two states. A token's score adds hashed features of itself (word, stems, last three
bytes) and of its neighbours; transitions and the start have weights of their own. It is fitted on the
whole texts of a bounded part of the labelled sample (``FIT_TEXTS``) by gradient steps on the exact
likelihood: marginals of single tokens and of neighbouring pairs both come from the recursions.

Scoring runs forward and backward over whole texts: with two states both recursions are chains of
fractional linear maps, which compose as 2 x 2 matrices, so a block is cut into columns that advance
side by side and the result is exact for any length. Marginals of at least 0.5 give the offending
spans; their largest and their sum give the document's score by a logistic curve fitted on the
labelled sample.

Null and empty texts have no tokens: no spans, and the score of a text without suspicion. Rows that
repeat are scored alike. Extra columns are ignored. Without labels of both kinds nothing is tagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, buffers, mix, ship, spans, text_bytes

BUCKETS = 1 << 15
FIT_TEXTS = 1500  # labelled texts that the field's weights are fitted on; words are mined from all
STEMS = (3, 4, 5, 6, 7)  # bytes
FEATURES = ("word", *(f"first {k} bytes" for k in STEMS), "last 3 bytes")

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, lower=True, inside=_INSIDE)


def _bucket(h: np.ndarray, seed: int) -> np.ndarray:
    return (mix(h + np.uint64(seed)) >> np.uint64(49)).astype(np.int64)


def own_features(data: np.ndarray, words: Words) -> list[np.ndarray]:
    """Buckets of what FEATURES names; where a token is no longer than the stem, the last bucket."""
    return [np.where(live, _bucket(h, i + 1), BUCKETS - 1) for i, (h, live) in enumerate(_hashes(data, words))]


def _hashes(data: np.ndarray, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    low = data.astype(np.uint64) | np.uint64(32)
    size, n = words.end - words.start, len(data)
    out = [(words.hash, np.ones(len(size), bool))]
    head = np.zeros(len(size), np.uint64)
    for k in range(max(STEMS)):
        head = mix(head * np.uint64(257) + low[np.minimum(words.start + k, n - 1)])
        if k + 1 in STEMS:
            out.append((head + np.uint64(k), size > k + 1))
    tail = np.zeros(len(size), np.uint64)
    for k in range(3):
        tail = tail * np.uint64(256) + low[np.maximum(words.end - 1 - k, 0)]
    return [*out, (tail, size > 3)]


@dataclass
class Field:
    own: np.ndarray  # len(FEATURES) x BUCKETS
    before: np.ndarray
    after: np.ndarray
    bias: float
    start: float
    moves: np.ndarray  # 2 x 2, log
    curve: np.ndarray  # see _curve
    ready: bool = True


def emissions(field: Field, data: np.ndarray, words: Words) -> np.ndarray:
    """For each token the score of state 1 less that of state 0."""
    own = own_features(data, words)
    u = sum(field.own[i][f] for i, f in enumerate(own)) + field.bias
    same = words.row[1:] == words.row[:-1]
    u[1:] += np.where(same, field.before[own[0][:-1]], 0)
    u[:-1] += np.where(same, field.after[own[0][1:]], 0)
    return u


def marginals(u: np.ndarray, fresh: np.ndarray, start: float, moves: np.ndarray, depth: int = 64) -> np.ndarray:
    """P(state 1) of each token; ``fresh`` marks the first token of each text."""
    forward, backward = odds(u, fresh, start, moves, depth)
    both = forward * backward
    return both / (1 + both)


def transitions(u: np.ndarray, fresh: np.ndarray, start: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of each token, and how many moves from a to b all texts are expected to hold (2 x 2)."""
    forward, backward = odds(u, fresh, start, moves)
    both = forward * backward
    inner = np.flatnonzero(~fresh[1:])
    t = np.exp(np.asarray(moves, float))
    came, goes = forward[inner], np.exp(np.clip(u, -40, 40))[inner + 1] * backward[inner + 1]
    pairs = np.stack([np.full(len(inner), t[0, 0]), t[0, 1] * goes, t[1, 0] * came, t[1, 1] * came * goes])
    return both / (1 + both), (pairs / pairs.sum(axis=0)).sum(axis=1).reshape(2, 2)


def odds(u: np.ndarray, fresh: np.ndarray, start: float, moves: np.ndarray, depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Odds of state 1 given the tokens up to each (it included), and those that the tokens after it give."""
    n = len(u)
    if not n:
        return u, u
    columns = -(-n // depth)
    e = np.exp(np.clip(u, -40, 40))
    t00, t01, t10, t11 = np.exp(np.asarray(moves, float)).ravel()
    ending = np.append(fresh[1:], True)

    def grid(v: np.ndarray, fill: float) -> np.ndarray:
        return np.append(v, np.full(columns * depth - n, fill)).reshape(columns, depth).T

    eg, fg, eng = grid(e, 1.0), grid(fresh, True).astype(bool), grid(ending, True).astype(bool)
    # forward odds: r -> e (t01 + t11 r) / (t00 + t10 r), or e * start
    fa, fb = np.where(fg, 0, eg * t11), np.where(fg, eg * np.exp(start), eg * t01)
    fc, fd = np.where(fg, 0, t10), np.where(fg, 1, t00)
    # backward odds: b -> (t10 + t11 e' b) / (t00 + t01 e' b) with the next token's e, or 1
    nxt = grid(np.append(e[1:], 1.0), 1.0)
    ba, bb = np.where(eng, 0, nxt * t11), np.where(eng, 1, t10)
    bc, bd = np.where(eng, 0, nxt * t01), np.where(eng, 1, t00)

    def chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, order: range, along: range) -> np.ndarray:
        pa_, pb, pc, pd = np.ones(columns), np.zeros(columns), np.zeros(columns), np.ones(columns)
        for i in order:
            pa_, pb, pc, pd = a[i] * pa_ + b[i] * pc, a[i] * pb + b[i] * pd, c[i] * pa_ + d[i] * pc, c[i] * pb + d[i] * pd
            if i % 4 == 0:
                scale = 1 / np.maximum(np.maximum(pa_, pb), np.maximum(pc, pd))
                pa_, pb, pc, pd = pa_ * scale, pb * scale, pc * scale, pd * scale
        begin, r = np.empty(columns), 1.0
        for k in along:
            begin[k] = r
            r = min(max((pa_[k] * r + pb[k]) / max(pc[k] * r + pd[k], 1e-300), 1e-250), 1e250)
        out, r = np.empty((depth, columns)), begin
        for i in order:
            r = (a[i] * r + b[i]) / (c[i] * r + d[i])
            out[i] = r
        return out

    forward = chain(fa, fb, fc, fd, range(depth), range(columns))
    backward = chain(ba, bb, bc, bd, range(depth - 1, -1, -1), range(columns - 1, -1, -1))
    return forward.T.ravel()[:n], backward.T.ravel()[:n]


def _contexts(texts: DataFrame, among: np.ndarray | None) -> DataFrame:
    """How many contexts (neighbouring tokens) each word and stem stands in; ``among``: only these."""
    held = texts.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in spans(offsets, 1 << 20):
                own = data[offsets[i] : offsets[j]]
                w = tokens_of(own, offsets[i : j + 1] - offsets[i])
                if not len(w.hash):
                    continue
                zero = np.zeros(1, np.uint64)
                context = mix(np.concatenate([zero, w.hash[:-1]]) * np.uint64(3) + np.concatenate([w.hash[1:], zero]))
                for h, live in _hashes(own, w)[:-1]:
                    if held.value is not None:
                        live = live & np.isin(h.view(np.int64), held.value)
                    if live.any():
                        pairs = np.unique(np.stack([h[live], context[live]], axis=1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["feature", "context"])

    return texts.select(text_bytes()).mapInArrow(run, "feature long, context long").distinct().groupBy("feature").count()


def suspects(sample: DataFrame, least: int = 6, ratio: float = 20.0) -> list[int]:
    """Fingerprints of words and stems that stand in ``least`` contexts or more in toxic texts and, per
    text, ``ratio`` times as often there as in others. All of them: how many there can be is bounded by the
    sample's texts alone."""
    totals = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return []
    seen = _contexts(sample.filter("label = 1"), None).filter(F.col("count") >= least)
    bad = {r[0]: r[1] for r in seen.toLocalIterator()}
    good = {r[0]: r[1] for r in _contexts(sample.filter("label = 0"), np.array(sorted(bad), np.int64)).collect()}
    odds = {h: n / totals[1] / ((good.get(h, 0) + 0.5) / totals[0]) for h, n in bad.items()}
    return sorted((h for h, o in odds.items() if o >= ratio), key=lambda h: (-odds[h], h))


def tagged(sample: DataFrame, words: list[int]) -> DataFrame:
    """Packed feature buckets and tags of all tokens of each text that has some."""
    held = sample.sparkSession.sparkContext.broadcast(np.array(sorted(words), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, out = batch.column(0).to_pylist(), []
            data, offsets = buffers(batch.column(1))
            for i, toxic in enumerate(label):
                own = data[offsets[i] : offsets[i + 1]]
                w = tokens_of(own, np.array([0, len(own)]))
                if len(w.hash):
                    tags = np.any([live & np.isin(h.view(np.int64), held.value) for h, live in _hashes(own, w)[:-1]], axis=0) & (toxic == 1)
                    out.append((np.stack(own_features(own, w)).astype("<u2").tobytes(), tags.astype(np.uint8).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["features", "tags"])

    return sample.select("label", text_bytes()).mapInArrow(run, "features binary, tags binary")


def fit_field(rows: list[tuple[bytes, bytes]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Maximum likelihood by AdaGrad on all texts at once."""
    f = np.concatenate([np.frombuffer(r[0], "<u2").reshape(len(FEATURES), -1) for r in rows], axis=1)
    y = np.concatenate([np.frombuffer(r[1], np.uint8) for r in rows])
    n = len(y)
    fresh = np.zeros(n, bool)
    fresh[np.cumsum([0, *(len(r[1]) for r in rows[:-1])])] = True
    joined = ~fresh[1:]  # whether a token and the next are of one text
    seen = np.array([[(joined & (y[:-1] == a) & (y[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    own, before, after = np.zeros((len(FEATURES), BUCKETS)), np.zeros(BUCKETS), np.zeros(BUCKETS)
    small = np.zeros(6)  # bias, start, moves
    small[0] = -4.0
    sums = {k: np.full(v.shape, 1e-8) for k, v in (("own", own), ("before", before), ("after", after), ("small", small))}
    for _ in range(rounds):
        u = np.full(n, small[0])
        for i in range(len(FEATURES)):
            u += own[i][f[i]]
        u[1:] += np.where(joined, before[f[0][:-1]], 0)
        u[:-1] += np.where(joined, after[f[0][1:]], 0)
        p, moved = transitions(u, fresh, small[1], small[2:].reshape(2, 2))
        g = y - p
        go = np.stack([np.bincount(f[i], g, BUCKETS) for i in range(len(FEATURES))])
        gb = np.bincount(f[0][:-1], np.where(joined, g[1:], 0), BUCKETS)
        ga = np.bincount(f[0][1:], np.where(joined, g[:-1], 0), BUCKETS)
        gs = np.array([g.sum(), g[fresh].sum(), *(seen - moved).ravel()])
        for name, theta, grad in (("own", own, go), ("before", before, gb), ("after", after, ga), ("small", small, gs)):
            grad = grad / n * 100 - decay * theta
            sums[name] += grad**2
            theta += rate * grad / np.sqrt(sums[name])
    return Field(own, before, after, float(small[0]), float(small[1]), small[2:].reshape(2, 2).copy(), np.array([-6.0, 1.0, 1.0, 0.0]))


def _curve(found: np.ndarray) -> np.ndarray:
    """Logistic weights of 1, logit of the largest marginal, log of 1 + sum, log of 1 + tokens; found:
    label, largest marginal, sum of marginals, tokens."""
    y = found[:, 0]
    p = np.clip(found[:, 1], 1e-6, 1 - 1e-6)
    a = np.column_stack([np.ones(len(y)), np.log(p / (1 - p)), np.log1p(found[:, 2]), np.log1p(found[:, 3])])
    w = np.zeros(4)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 0.05 * np.eye(4)
        w += np.linalg.solve(h, a.T @ (y - p) - 0.05 * w)
    return w


def tag(docs: DataFrame, field: Field, keep: list[Column]) -> DataFrame:
    """row, largest and total (of marginals), tokens, spans (start byte, bytes, largest marginal)."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    given = docs.select(F.struct(*keep).alias("row"), text_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64()), ("marginal", pa.float64())]))
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            largest, total, tokens = (np.zeros(batch.num_rows) for _ in range(3))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, j in spans(offsets, 1 << 18):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                w = tokens_of(own, at)
                if not len(w.hash) or not m.ready:
                    continue
                fresh = np.append(True, w.row[1:] != w.row[:-1])
                p = marginals(emissions(m, own, w), fresh, m.start, m.moves)
                rows = np.flatnonzero(w.count)
                tokens[i:j] = w.count
                largest[i + rows] = np.maximum.reduceat(p, w.at[rows])
                total[i + rows] = np.add.reduceat(p, w.at[rows])
                last = -2
                for k in np.flatnonzero(p >= 0.5):
                    spot, begin = found[i + w.row[k]], int(w.start[k] - at[w.row[k]])
                    if k == last + 1 and not fresh[k]:
                        spot[-1] |= {"bytes": int(w.end[k] - at[w.row[k]]) - spot[-1]["start"], "marginal": max(spot[-1]["marginal"], float(p[k]))}
                    else:
                        spot.append({"start": begin, "bytes": int(w.end[k] - w.start[k]), "marginal": float(p[k])})
                    last = k
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(largest), pa.array(total), pa.array(tokens), pa.array(found, kind)], names=["row", "largest", "total", "tokens", "spans"])

    return given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, largest double, total double, tokens double, spans array<struct<start:long,bytes:long,marginal:double>>")


def fit(sample: DataFrame) -> Field:
    """``sample``: text, label, of a bounded number of rows."""
    ship(sample.sparkSession)
    words = suspects(sample)
    if not words:
        none = np.zeros(BUCKETS)
        return Field(np.zeros((len(FEATURES), BUCKETS)), none, none, 0.0, 0.0, np.zeros((2, 2)), np.array([-6.0, 0.0, 0.0, 0.0]), False)
    some = sample.orderBy(F.xxhash64("text", F.lit("field")), "text", "label").limit(FIT_TEXTS)
    field = fit_field(sorted((bytes(r[0]), bytes(r[1])) for r in tagged(some, words).collect()))
    found = np.array([tuple(r) for r in tag(sample, field, [F.col("label")]).select("row.label", "largest", "total", "tokens").collect()], float)
    field.curve = _curve(found)
    return field


def score(docs: DataFrame, field: Field, keep: list[Column], threshold: float = 0.5) -> DataFrame:
    """row, score, predicted, spans."""
    w = [float(x) for x in field.curve]
    p = F.least(F.greatest(F.col("largest"), F.lit(1e-6)), F.lit(1 - 1e-6))
    z = F.lit(w[0]) + F.lit(w[1]) * F.log(p / (1 - p)) + F.lit(w[2]) * F.log1p("total") + F.lit(w[3]) * F.log1p("tokens")
    found = tag(docs, field, keep).select("row", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score"), "spans")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
