"""The model itself: class probabilities sum to one, and history pays on held-out texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("quirework.llm")

from quirework.llm import lm  # noqa: E402


def test_class_probabilities_sum_to_one() -> None:
    rng = np.random.default_rng(2)
    table = rng.normal(size=(lm.BUCKETS * (lm.GROUPS + 1), lm.WIDTH)).astype(np.float32)
    bias = lm.bias_of(rng.integers(0, 50, lm.CLASSES).astype(float))
    history = rng.integers(0, lm.BUCKETS, (lm.FEATURES, 1)).astype(np.int16)
    every = np.repeat(history, lm.CLASSES, axis=1)
    assert np.isclose(np.exp(lm.log_class(table, bias, every, np.arange(lm.CLASSES))).sum(), 1, atol=1e-4)


def test_partial_sums_weigh_by_use() -> None:
    n, moved = np.array([2, 0, 5]), np.arange(3 * lm.WIDTH).reshape(3, -1) / 8
    whole = lm._weighted(lm._sent(n, moved))
    assert np.allclose(whole[:3], n) and np.allclose(whole[3:], (n[:, None] * moved).ravel())


def test_history_pays_on_held_out_texts(spark) -> None:  # noqa: ANN001
    rng = random.Random(5)
    tongues = [[f"{a}{i}" for i in range(60)] for a in ("ab", "cd", "ef")]
    texts = [" ".join(rng.choice(tongues[i % 3]) for _ in range(60)) for i in range(3000)]
    found = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("held_out").groupBy().sum("score", "base_score", "n_tokens").first()
    assert found["sum(score)"] > found["sum(base_score)"] + 0.15 * found["sum(n_tokens)"]


def test_a_text_longer_than_a_block(spark, monkeypatch) -> None:  # noqa: ANN001
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    docs = spark.createDataFrame([(0, text), (1, "w1 w2"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    assert got[0].n_tokens == 300_001 and got[1].n_tokens == 3 and got[2].n_tokens == 1 and all(np.isfinite(r.score) for r in got.values())


def test_rows_are_ordered_as_by_a_stable_sort():  # noqa: ANN201
    rng = np.random.default_rng(5)
    rows = rng.choice([0, 1, 65535, 65536, 65537, lm.BUCKETS * (lm.GROUPS + 1) - 1, *rng.integers(0, lm.BUCKETS * (lm.GROUPS + 1), 50)], 8192).astype(np.int32)
    assert (lm.by_value(rows) == np.argsort(rows, kind="stable")).all()
    assert len(lm.by_value(rows[:0])) == 0
