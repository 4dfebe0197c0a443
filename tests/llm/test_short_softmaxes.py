"""Softmaxes of a batch share one shift; what that would lose gets its own."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("quirework.llm")

from quirework.llm import lm  # noqa: E402


def given(spread: float) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(5)
    table = rng.normal(0, 1, (lm.BUCKETS * (lm.GROUPS + 1), lm.WIDTH)).astype(np.float32)
    table[:: lm.GROUPS + 1] -= np.float32(spread)  # scores of groups lie far below those of classes
    bias = lm.bias_of(rng.integers(1, 100, lm.CLASSES).astype(float))
    return table, bias, rng.integers(0, lm.BUCKETS, (lm.FEATURES, 700)).astype(np.int16), rng.integers(0, lm.CLASSES, 700)


@pytest.mark.parametrize("spread", [0.0, 100.0])
def test_exponentials_are_those_of_each_softmax(spread: float) -> None:
    table, bias, features, klass = given(spread)
    rows, own, y = lm.rows_of(features, klass)
    s = (sum(table[r].astype(float) for r in rows) + bias[own]).astype(float)
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    e, total, right = lm._exps(table, bias, rows, own, y)
    assert np.allclose(e / total[:, None], p, rtol=1e-3, atol=1e-6)
    assert np.allclose(right - np.log(total), np.log(p[np.arange(len(y)), y]), rtol=1e-3, atol=1e-3)
    both = np.log(p[np.arange(len(y)), y]).reshape(2, -1).sum(axis=0)
    assert np.allclose(lm.log_class(table, bias, features, klass), both, rtol=1e-3, atol=1e-3)


def test_no_tokens() -> None:
    table, bias, features, klass = given(0.0)
    assert len(lm.log_class(table, bias, features[:, :0], klass[:0])) == 0
