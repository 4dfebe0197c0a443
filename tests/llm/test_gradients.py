"""The field's expected moves against all taggings, and BM25 parts against one index."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

pytest.importorskip("quirework.llm")

from quirework.llm import decontaminate, langid, toxicity  # noqa: E402


def test_expected_moves_are_exact() -> None:
    rng = np.random.default_rng(6)
    u, moves, start = rng.normal(size=9), rng.normal(size=(2, 2)), 0.4
    fresh = np.zeros(9, bool)
    fresh[[0, 4, 5]] = True
    p, moved = toxicity.transitions(u, fresh, start, moves)
    brute, single = np.zeros((2, 2)), []
    for lo, hi in ((0, 4), (4, 5), (5, 9)):
        total, on, at = 0.0, np.zeros(hi - lo), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=hi - lo):
            w = np.exp(start * tags[0] + sum(u[lo + i] * t for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in itertools.pairwise(tags)))
            total, on = total + w, on + w * np.array(tags)
            for a, b in itertools.pairwise(tags):
                at[a, b] += w
        brute += at / total
        single.append(on / total)
    assert np.allclose(moved, brute) and np.allclose(p, np.concatenate(single))


def test_parts_of_items_change_nothing(spark) -> None:  # noqa: ANN001
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 40))) + ". " + " ".join(rng.choice(words) for _ in range(5))) for i in range(80)]
    half = lambda t: " ".join(w if rng.random() < 0.6 else "zz" for w in t.split())
    docs = [(i, "x y z " + (half(t) if i % 2 else t) + " tail") for i, t in items] + [(900, None), (901, ""), (None, items[3][1]), (5, items[5][1])]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [sorted((str(r.doc_id), r.item_id, round(r.score, 9)) for r in decontaminate.find(d, it, overlap=0.0, most_bytes=m).collect()) for m in (1 << 20, 700)]
    assert found[0] == found[1] and len(found[0]) >= 40


def test_scores_are_bm25(spark) -> None:  # noqa: ANN001
    """Every pair at or above the threshold, scored by the formula itself, is found where a passage is the whole text."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 16)))) for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(14))) for i in range(40)]
    n, mean = len(items), np.mean([len(t.split()) for _, t in items])
    df = {w: sum(w in t.split() for _, t in items) for w in words}

    def impact(w: str, t: list[str]) -> float:
        tf = t.count(w)
        return np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))

    expected = set()
    for d, text in docs:
        for i, item in items:
            t = item.split()
            whole, got = sum(impact(w, t) for w in set(t)), sum(impact(w, t) for w in set(t) & set(text.split()))
            if got / whole >= 0.5:
                expected.add((d, i))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(a, b, overlap=0.0).collect()} == expected


def test_rejection_is_calibrated(spark) -> None:  # noqa: ANN001
    rng = random.Random(4)
    tongues = {"aa": ["the", "and", "thing", "other", "with"], "bb": ["der", "und", "schein", "nicht", "ein"], "cc": ["que", "los", "ción", "para", "una"]}
    text = lambda ws: " ".join(rng.choice(ws) for _ in range(30))
    rows = [(i, text(tongues[k]), k) for i, k in enumerate(list(tongues) * 120)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, label string"))
    strange = [(1000 + i, " ".join("".join(rng.choice("ъыьжщю") for _ in range(5)) for _ in range(30))) for i in range(30)]
    clean = [(2000 + i, text(tongues[k])) for i, k in enumerate(list(tongues) * 20)]
    from pyspark.sql import functions as F

    got = {r["row"]["doc_id"]: r["rejected"] for r in langid.predict(spark.createDataFrame(strange + clean, "doc_id long, text string"), model, [F.col("doc_id")]).collect()}
    assert sum(got[i] for i, _ in strange) >= 27 and sum(got[i] for i, _ in clean) <= 1


def test_case_beyond_ascii(spark) -> None:  # noqa: ANN001
    item = "La éai éonleeau pour an éonqueê aivi ai. Èeuxmenten éauxouai et éè"
    docs = spark.createDataFrame([(1, "und " * 20 + item.upper() + " tail"), (2, "und " * 20)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.find(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [1]
