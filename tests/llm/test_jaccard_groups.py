"""Near copies that share their prefix and size but don't link with the head of their group."""

from __future__ import annotations

import itertools

import pytest

pytest.importorskip("quirework.llm")

from quirework.llm import jaccard_join  # noqa: E402


def shingles(text: str) -> set[tuple[str, ...]]:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(texts: list[str]) -> list[int]:
    root = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_jaccard_links_inside_a_group(spark):  # noqa: ANN001, ANN201
    """Two texts link with each other but not with the head of their group; the words, and so the hash
    order, differ in every family, and no shingle stands in two families."""
    texts = []
    for k in range(300):
        c = " ".join(f"c{k}w{i}" for i in range(12))
        texts += [f"{c} x{k} y{k}", f"{c} u{k} v{k}", f"{c} u{k} w{k}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked(docs).collect()}
    assert [found[i] for i in range(len(texts))] == [b + 3 * k for k in range(300) for b in brute_components(texts[3 * k : 3 * k + 3])]
