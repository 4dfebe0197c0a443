"""Content-chosen anchors: the positions at which long repeats are looked for.

For every window of ``length`` symbols the anchor is the k-gram with the least hash among its first
``reach`` k-grams (leftmost on a tie), so equal windows have equal anchors at equal distances. The
windows that share an anchor form a run: neighbouring starts, about reach/2 of them. Whatever
repeats anywhere repeats around an anchor; comparing anchors instead of all positions cuts the rows
that travel by that factor and loses nothing.

Fingerprints are polynomials modulo 2**64 over random 64-bit symbols; whatever decides that two
windows are equal uses two of them (128 bits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from .common import Words, mix, random_words, spans

_BASES = tuple(int(x) | 1 for x in random_words(2, 99))
_LOW = np.uint64((1 << 24) - 1)
_powers: list[tuple[np.ndarray, np.ndarray]] = []
_BYTE = random_words(256, 5)


def _raised(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, up to n."""
    if not _powers or len(_powers[0][0]) < n:
        n = max(n, 1 << 18)
        _powers[:] = []
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            _powers.append((pair[0], pair[1]))
    return _powers


class Prints:
    """Fingerprints of any stretch of ``symbols`` in constant time."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums, self.down = [], []
        for up, down in _raised(n + 1):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(symbols * up[:n], out=s[1:])
            self.sums.append(s)
            self.down.append(down)

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return (s[end] - s[start]) * self.down[which][start]

    def grams(self, k: int) -> np.ndarray:
        s = self.sums[0]
        return mix((s[k:] - s[:-k]) * self.down[0][: len(s) - k])


@dataclass(frozen=True)
class Shape:
    """Windows of ``length`` symbols; anchors of ``k`` among the first ``reach`` k-grams."""

    length: int
    reach: int
    k: int

    def __post_init__(self) -> None:
        if self.reach + self.k - 1 > self.length:
            raise ValueError("anchors must lie inside their window")

    @property
    def shared(self) -> int:
        """Symbols from the anchor on that every one of its windows holds."""
        return self.length - self.reach + 1


@dataclass
class Runs:
    row: np.ndarray
    start: np.ndarray  # of the first window, in the row
    windows: np.ndarray
    keys: list[np.ndarray]  # fingerprints of equal shares of the stretch that all windows hold
    whole: list[np.ndarray]  # two fingerprints of all that the windows hold


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    b = 1
    while 2 * b <= width:
        values = np.minimum(values[:-b], values[b:])
        b *= 2
    if r := width - b:
        values = np.minimum(values[:-r], values[r:])
    return values


def runs_of(symbols: np.ndarray, offsets: np.ndarray, shape: Shape, shares: int) -> Runs:
    """The runs of rows that lie one after another in ``symbols``."""
    none = np.zeros(0, np.int64)
    n, sizes = len(symbols), np.diff(offsets)
    starts = np.maximum(sizes - shape.length + 1, 0)
    if not starts.any():
        return Runs(none, none, none, [none.astype(np.uint64)] * shares, [none.astype(np.uint64)] * 2)
    prints = Prints(symbols)
    value = prints.grams(shape.k)
    value = (value & ~_LOW) | np.arange(len(value), dtype=np.uint64)
    anchor = (least(value, shape.reach) & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), starts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + offsets[row]
    own = anchor[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    lo, hi, a = at[first], at[last], own[first]
    step = shape.shared // shares
    keys = [mix(prints.of(a + i * step, a + (i + 1) * step)) for i in range(shares)]
    form = mix(((a - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64))
    whole = [mix(prints.of(lo, hi + shape.length, w) ^ form) for w in (0, 1)]
    return Runs(row[first], lo - offsets[row[first]], hi - lo + 1, keys, whole)


def window_prints(symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    prints = Prints(symbols)
    return mix(prints.of(starts, starts + length, 0)), mix(prints.of(starts, starts + length, 1))


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _BYTE[data], offsets


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, offsets)
    return words.hash, words.at


Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def each_run(data: np.ndarray, offsets: np.ndarray, symbols_of: Symbols, shape: Shape, shares: int, block: int = 1 << 18) -> Iterator[Runs]:
    """Runs of a batch of texts, block by block; a long text is cut with an overlap of one window less
    a symbol, which may split a run in two but keeps every window exactly once."""
    for i, j in spans(offsets, block):
        symbols, at = symbols_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if len(symbols) <= 2 * block:
            found = runs_of(symbols, at, shape, shares)
            found.row = found.row + i
            yield found
            continue
        for cut in range(0, len(symbols) - shape.length + 1, block):
            part = symbols[cut : cut + block + shape.length - 1]
            found = runs_of(part, np.array([0, len(part)]), shape, shares)
            found.row, found.start = found.row + i, found.start + cut
            yield found
