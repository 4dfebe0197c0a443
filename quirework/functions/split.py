"""Splitting texts at a token limit, by one scan of where tokens begin."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Characters after which a text is preferably cut, and the classes that estimated tokens rest on.
BOUNDARIES = "\n \t,;:.!?。，；：！？"
WORD, CJK, SIGN = r"[A-Za-z0-9_]+", r"[㐀-鿿]", r"[^\w\s㐀-鿿]"
KEEP = 0.55
_NEXT = re.compile(r"\S")


def _running(n: int, at: Iterator[int]) -> np.ndarray:
    """At i how many of the positions lie before i."""
    held = np.zeros(n + 1, np.int64)
    held[1 + np.fromiter(at, np.int64)] = 1
    return np.cumsum(held)


class Scan:
    """Estimated tokens of any part of a text, from running counts."""

    def __init__(self, text: str):
        n = len(text)
        spans = [m.span() for m in re.finditer(WORD, text)]
        self.words, self.cjk, self.signs = (_running(n, p) for p in ((a for a, _ in spans), (m.start() for m in re.finditer(CJK, text)), (m.start() for m in re.finditer(SIGN, text))))
        self.inside = np.zeros(n + 1, bool)  # whether a word goes on at the position
        for a, b in spans:
            self.inside[a + 1 : b] = True

    def tokens(self, a: int, b: int) -> int:
        count = lambda running: int(running[b] - running[a])
        words = count(self.words) + int(b > a and self.inside[a])
        return max(1, words + (count(self.cjk) + 1) // 2 + count(self.signs) // 4)


def split_at(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` estimated tokens, cut behind the last boundary in the last 45 per cent, or where
    the limit falls. What a text's tokens are is read once; each cut is a search in running counts."""
    text = text.strip()
    scan, n = Scan(text), len(text)
    ends = [m.end() for m in re.finditer(f"[{re.escape(BOUNDARIES)}]", text)]
    out, at = [], 0
    while at < n and scan.tokens(at, n) > most:
        fits = max(1, bisect_right(range(at + 1, n), most, key=lambda b, a=at: scan.tokens(a, b)))
        k = bisect_right(ends, at + fits)
        good = k and ends[k - 1] >= at + max(1, int(fits * KEEP))
        cut = ends[k - 1] if good else at + fits
        if piece := text[at:cut].rstrip():
            out.append(piece)
        following = _NEXT.search(text, cut)
        at = following.start() if following else n
    return [*out, text[at:]] if at < n else out


def splitter(most: int):  # noqa: ANN201
    """A column function that gives the pieces of a text."""

    @F.pandas_udf(ArrayType(StringType()))
    def pieces(text: pd.Series) -> pd.Series:
        return text.map(lambda t: split_at(t or "", most))

    return pieces
