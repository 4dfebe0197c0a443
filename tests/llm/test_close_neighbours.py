"""Nearest neighbours among vectors whose codes hardly differ: compared with all cosines."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import ann


def tight(rng: np.random.Generator) -> np.ndarray:
    return rng.normal(size=(4, 16))[rng.integers(0, 4, 3000)] + 1e-3 * rng.normal(size=(3000, 16))


def shifted(rng: np.random.Generator) -> np.ndarray:
    return 20 + rng.normal(size=(3000, 16))


def mixed(rng: np.random.Generator) -> np.ndarray:
    return np.concatenate([rng.normal(size=(2000, 16)), 5 + 1e-2 * rng.normal(size=(1000, 16))])[rng.permutation(3000)]


@pytest.mark.parametrize("shape", [tight, shifted, mixed])
def test_none_of_the_nearest_is_missed(spark, shape):  # noqa: ANN001, ANN201
    x = shape(np.random.default_rng(3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(dict)
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id][r.rank] = r.vec_id
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s, kind="stable")[:5].tolist()) & set(got[q].values()))
    assert hits >= 0.99 * 5 * 60
