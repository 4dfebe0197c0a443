"""Quality classifier: a sparse rule ensemble over text statistics.

1. ``statistics``: about twenty figures of each whole text (lengths, shares of byte classes, how often
   words, word pairs and lines repeat).
2. ``fit``: small boosted trees on a bounded labelled sample; every path from the root becomes a rule,
   a conjunction of comparisons; a logistic model with lasso weights keeps few of the rules.
3. ``score``: the kept rules are compiled into one Spark column expression over the figures.

Null and empty texts have all figures 0 and get a score as any other. Rows that repeat are scored
alike. Extra columns are ignored. With labels of one kind only, or none, the score is their mean
(0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, buffers, ship, spans, text_bytes

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".,;:",
    "shout": b"!?",
    "bar": b"|",
    "sign": b"#$%&*@^~+=<>_/\\",
    "bracket": b"()[]{}\"'",
    "high": range(128, 256),
    "line": b"\n",
}
NAMES = ["bytes", "words", "word_size", *_CLASSES, "repeat_next", "distinct_words", "distinct_pairs", "top_word", "line_size", "repeat_lines", "long_words"]
_NEWLINE = np.ones(256, bool)
_NEWLINE[[10, 13]] = False


def figures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    rows, sizes = len(offsets) - 1, np.diff(offsets).astype(float)
    out = np.zeros((rows, len(NAMES)))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    put = lambda name, values: out.__setitem__((slice(None), NAMES.index(name)), values)
    for name, members in _CLASSES.items():
        member = np.zeros(256, np.int32)
        member[list(members)] = 1
        share = np.zeros(rows)
        share[full] = np.add.reduceat(member[data], offsets[:-1][full]) / sizes[full]
        put(name, share)
    words = Words(data, offsets, lower=True)
    lines = Words(data, offsets, inside=_NEWLINE, seed=2)
    n, m = words.count, lines.count
    put("bytes", np.log1p(sizes))
    put("words", np.log1p(n))
    length = words.end - words.start
    put("word_size", np.bincount(words.row, length, minlength=rows) / np.maximum(n, 1))
    put("long_words", np.bincount(words.row, length > 25, minlength=rows) / np.maximum(n, 1))
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    put("repeat_next", np.bincount(words.row, same, minlength=rows) / np.maximum(n, 1))
    put("line_size", np.log1p(sizes / np.maximum(m, 1)))
    distinct, pairs, top, again = (np.zeros(rows) for _ in range(4))
    for i in np.flatnonzero(n):
        own = words.hash[words.at[i] : words.at[i + 1]]
        _, counts = np.unique(own, return_counts=True)
        distinct[i], top[i] = len(counts) / n[i], counts.max() / n[i]
        pairs[i] = len(np.unique(own[1:] * np.uint64(3) + own[:-1])) / max(1, n[i] - 1)
        again[i] = 1 - len(np.unique(lines.hash[lines.at[i] : lines.at[i + 1]])) / max(1, m[i])
    put("distinct_words", distinct)
    put("distinct_pairs", pairs)
    put("top_word", top)
    put("repeat_lines", again)
    return out


def statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """row (a struct of the kept columns) and one double for each of NAMES."""
    given = docs.select(F.struct(*keep).alias("row"), text_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            found = [figures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in spans(offsets, 1 << 18)]
            table = np.concatenate([*found, np.zeros((0, len(NAMES)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(table[:, c]) for c in range(len(NAMES))]], names=["row", *NAMES])

    return given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, " + ", ".join(f"`{n}` double" for n in NAMES))


Rule = tuple[tuple[int, bool, float], ...]  # (figure, above?, threshold) all hold


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: np.ndarray
    bias: float

    def column(self) -> Column:
        """The score as one expression over the figures."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for c, above, t in rule:
                holds = holds & ((F.col(NAMES[c]) > t) if above else (F.col(NAMES[c]) <= t))
            total = total + F.when(holds, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + holding(self.rules, x) @ self.weights)))

    def describe(self) -> list[str]:
        return [f"{w:+.3f}  " + " and ".join(f"{NAMES[c]} {'>' if a else '<='} {t:.4g}" for c, a, t in r) for r, w in zip(self.rules, self.weights, strict=True)]


def holding(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Which rules hold for which rows, as 0 and 1."""
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for c, above, t in rule:
            out[:, k] *= (x[:, c] > t) if above else (x[:, c] <= t)
    return out


def _tree(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """The paths of one tree fitted to the gradients, and its values for all rows."""
    paths: list[Rule] = []
    value = np.zeros(len(x))

    def grow(rows: np.ndarray, path: Rule) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, 0.0)
        if len(path) < depth and len(rows) >= 2 * least:
            for c, edges in enumerate(cuts):
                at = np.searchsorted(edges, x[rows, c], "left")  # below: x <= edges[at]
                gs = np.cumsum(np.bincount(at, grad[rows], len(edges) + 1))[:-1]
                hs = np.cumsum(np.bincount(at, hess[rows], len(edges) + 1))[:-1]
                ns = np.cumsum(np.bincount(at, minlength=len(edges) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), c, float(edges[int(gain.argmax())]))
        if best[1] < 0:
            value[rows] = -g / (h + 1)
            return
        _, c, t = best
        under = x[rows, c] <= t
        for side, above in ((rows[under], False), (rows[~under], True)):
            paths.append((*path, (c, above, t)))
            grow(side, paths[-1])

    grow(np.arange(len(x)), ())
    return paths, value


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps."""
    n, k = a.shape
    step = 4.0 / max(1e-9, np.linalg.norm(np.column_stack([a, np.ones(n)]), 2) ** 2 / n)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    pw, pb, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ pw + pb))) - y
        nw = pw - step * (a.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = pb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def fit_rows(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, penalties: tuple[float, ...] = (0.01, 0.003, 0.001, 0.0003)) -> Ensemble:
    if len(np.unique(y)) < 2:
        mean = float(y.mean()) if len(y) else 0.5
        mean = min(max(mean, 1e-3), 1 - 1e-3)
        return Ensemble([], np.zeros(0), float(np.log(mean / (1 - mean))))
    least = max(2, min(20, len(y) // 50))
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0.01, 0.99, 48))) for c in range(x.shape[1])]
    f, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), dict[Rule, None]()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        paths, value = _tree(x, cuts, p - y, p * (1 - p), depth, least)
        rules.update(dict.fromkeys(paths))
        f += rate * value
    found = list(rules)
    if not found:
        return Ensemble([], np.zeros(0), float(f[0]))
    a = holding(found, x)
    part = np.arange(len(y)) % 4 == 0
    if len(np.unique(y[~part])) == 2 and part.sum() >= 20:
        losses = []
        for penalty in penalties:
            w, b = _lasso(a[~part], y[~part], penalty)
            p = np.clip(1 / (1 + np.exp(-(a[part] @ w + b))), 1e-6, 1 - 1e-6)
            losses.append(-(y[part] * np.log(p) + (1 - y[part]) * np.log(1 - p)).mean())
        penalty = penalties[int(np.argmin(losses))]
    else:
        penalty = penalties[1]
    w, b = _lasso(a, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble([found[i] for i in kept], w[kept], b)


def fit(sample: DataFrame, **options: float) -> Ensemble:
    """``sample``: text, label, of a bounded number of rows; only their figures reach the driver."""
    ship(sample.sparkSession)
    rows = statistics(sample, [F.col("label")]).select("row.label", *NAMES).collect()
    table = np.array(sorted(tuple(r) for r in rows), dtype=float).reshape(len(rows), len(NAMES) + 1)
    order = np.random.default_rng(3).permutation(len(table))
    return fit_rows(table[order, 1:], table[order, 0], **options)


def score(docs: DataFrame, model: Ensemble, keep: list[Column], threshold: float = 0.3) -> DataFrame:
    """row, score, predicted."""
    scored = statistics(docs, keep).select("row", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
