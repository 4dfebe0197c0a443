"""Pairs with drawn pivots: only members that may be similar meet."""

from __future__ import annotations

import pytest

pytest.importorskip("quirework.llm")

from quirework.llm import jaccard_join as J  # noqa: E402


def drawn(spark, n: int, beside: list[list[int]], places: list[int], words: list[int]):  # noqa: ANN001, ANN201
    """The pairs of two members of one shingle, the first in its main component."""
    rows = [(7, k + 1, min(k, 1) + 1, n, places[min(k, 1)], beside[min(k, 1)], *[words[min(k, 1)]] * J.PARITY) for k in (0, 1)]
    rows.append((7, 3, 1, n, places[0], beside[0], *[words[0]] * J.PARITY))
    ddl = "shingle long, sig long, root long, n long, at int, beside array<long>, " + ", ".join(f"p{k} long" for k in range(J.PARITY))
    return {tuple(r) for r in J.drawn(spark.createDataFrame(rows, ddl), 0, 80).collect()}


def test_texts_that_share_one_shingle_by_chance_are_not_drawn(spark):  # noqa: ANN001, ANN201
    assert drawn(spark, 2000, [[1, 2], [2, 3]], [40, 40], [0, 0])
    assert not drawn(spark, 2000, [[1, 2], [3, 4]], [40, 40], [0, 0])
    assert drawn(spark, 2000, [[], [3, 4]], [40, 40], [0, 0])  # a shingle alone tells nothing
    assert not drawn(spark, 2000, [[1, 2], [2, 3]], [0, 390], [0, 0])  # 390 before and 1610 behind leave too few
    assert not drawn(spark, 600, [[1, 2], [2, 3]], [40, 40], [0, 0x5555555555555555])  # 256 bits of 512 differ
