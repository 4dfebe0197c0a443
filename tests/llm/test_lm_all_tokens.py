"""Every token of every training document gives a gradient."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("quirework.llm")

from quirework.llm import lm  # noqa: E402


def test_gradients_cover_all_tokens(spark, monkeypatch):  # noqa: ANN001, ANN201
    """The rounds' phases together pick each token once, whatever the number of rounds."""
    rounds = []
    whole = lm._round

    def spy(blocks, table, bias, own, stride, phase, tasks):  # noqa: ANN001, ANN202
        rounds.append((stride, phase))
        return whole(blocks, table, bias, own, stride, phase, tasks)

    monkeypatch.setattr(lm, "_round", spy)
    docs = spark.createDataFrame([(i, f"a{i} b c") for i in range(40)], "doc_id long, text string")
    for options in ({}, {"rounds": 1}, {"rounds": 3}):
        rounds.clear()
        lm.score(docs, **options)
        taken = np.zeros(100, int)
        for stride, phase in rounds:
            taken[phase::stride] += 1
        assert (taken == 1).all()


def test_every_event_trains(spark, monkeypatch):  # noqa: ANN001, ANN201
    """All features of all training tokens leave their rows of the weights changed, also those at positions 2 and 3 of 4."""
    docs = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i}") for i in range(40)], "doc_id long, text string")
    tables = []
    whole = lm._round

    def spy(*args):  # noqa: ANN002, ANN202
        tables.append((args[3], whole(*args)))
        return tables[-1][1]

    monkeypatch.setattr(lm, "_round", spy)
    lm.score(docs)
    own, table = tables[-1]
    from quirework.llm.common import fold

    texts = [r["text"].encode() for r in docs.filter(fold(7) != 2).collect()]
    offsets = np.cumsum([0, *map(len, texts)])
    e = lm.events_of(np.frombuffer(b"".join(texts), np.uint8), offsets, own)
    assert (np.abs(table[e.features.astype(np.int64)]).sum(axis=2) > 0).all()
