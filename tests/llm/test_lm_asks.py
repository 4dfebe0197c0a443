"""Distinct words of a block, found piece by piece: same counts, and memory that the block's size doesn't set."""

from __future__ import annotations

import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quirework.llm import lm


class Frame:
    """Stands in for a DataFrame: hands the function over as Spark would."""

    def select(self, *_: str) -> Frame:
        return self

    def mapInArrow(self, run, _: str):  # noqa: ANN001, ANN201, N802
        return run


def batch(texts: list[str], held: list[bool], block: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(held), pa.array([t.encode() for t in texts], pa.binary())], names=["block", "held_out", "text"])


def test_counts_of_pieces(monkeypatch):  # noqa: ANN001, ANN201
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    held, block = [rng.random() < 0.3 for _ in texts], [i // 70 for i in range(200)]
    monkeypatch.setattr(lm, "PIECE", 500)
    got = {b: collections.Counter() for b in range(3)}
    for out in lm._asks(Frame())(iter([batch(texts, held, block)])):
        rows = out.to_pylist()
        assert len({r["word"] for r in rows}) == len(rows)
        got[rows[0]["block"]].update(sorted(r["n"] for r in rows))
    for b in range(3):
        want = collections.Counter()
        for t, h, k in zip(texts, held, block, strict=True):
            if k == b:
                for w in t.split():
                    want[w] += not h
        assert got[b] == collections.Counter(want.values())


def test_memory_of_a_full_block():  # noqa: ANN201
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(5000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 5000, 300)) for _ in range(lm.BLOCK_BYTES // 2100)]
    given = batch(texts, [False] * len(texts), [0] * len(texts))
    tracemalloc.start()
    found = list(lm._asks(Frame())(iter([given])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 5000 and most < 8 * lm.BLOCK_BYTES
