"""Texts of ordinary pages are not taken apart to find what they hold; those of crowded pages are, with the same pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quirework.operators import sequences


def test_grams_only_of_crowded_pages(spark, monkeypatch):  # noqa: ANN001, ANN201
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("ab") for _ in range(n))
    left = [(p, i, text(rng.randint(5, 40))) for p in range(3) for i in range(30)]
    right = [(p, i, text(rng.randint(5, 14))) for p in range(3) for i in range(40 if p < 2 else 90)]
    one = spark.createDataFrame(left, "page int, a int, left string")
    two = spark.createDataFrame(right, "page int, b int, right string")
    made = []
    grams = sequences._grams

    def counted(df, *rest):  # noqa: ANN001, ANN002, ANN202
        found = grams(df, *rest)
        made.append({r["page"] for r in found.select("page").distinct().collect()})
        return found

    monkeypatch.setattr(sequences, "_grams", counted)
    want = sorted((p, i, j) for p, i, s in left for q, j, t in right if p == q and min(len(s), len(t)) >= 8 and (s[:8] in t or t[:8] in s))
    for heads, pages in ((50, {2}), (256, set()), (10, {0, 1, 2})):
        monkeypatch.setattr(sequences, "HEADS", heads, raising=False)
        made.clear()
        got = sequences.gram_pairs(one, two, ["page"], ("a", "left"), ("b", "right"))
        assert sorted(tuple(r) for r in got.select("page", "a", "b").collect()) == want
        assert set().union(*made) == pages


def test_runs_across_stretches(spark, monkeypatch):  # noqa: ANN001, ANN201
    """A run is found wherever it begins on a page of many lines."""
    rng = random.Random(9)
    lines = [(1, i * 3, "".join(rng.choice("abcdef") for _ in range(12))) for i in range(200)]
    blocks = [(1, k, "".join(x[2] for x in lines[k : k + 20])) for k in range(0, 180, 9)]
    found = sequences.holding_runs(spark.createDataFrame(blocks, "page int, block_id int, key string"), spark.createDataFrame(lines, "page int, at int, key string"), ["page"])
    assert {(r["block_id"], r["first_line"], r["lines"], r["score"]) for r in found.collect()} == {(k, k * 3, 20, 0) for _, k, _ in blocks}
    assert found.select(F.count("*")).first()[0] == 20
