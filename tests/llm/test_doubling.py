"""Prefix doubling: ranks themselves, the first copy kept, and a text longer than a block."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("quirework.llm")

from quirework.llm import suffix_dedup  # noqa: E402


def brute(rows: list[tuple], length: int, keep_first: bool) -> collections.Counter:
    place = lambda i, p: (i is not None, i or 0, p)
    least: dict[bytes, tuple] = {}
    seen: collections.Counter = collections.Counter()
    for i, t in rows:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            seen[s] += 1
            least[s] = min(least.get(s, place(i, p)), place(i, p))
    out: collections.Counter = collections.Counter()
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if least[s] < place(i, p) if keep_first else seen[s] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[i, len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("keep_first", [True, False])
def test_against_brute_force(spark, keep_first: bool) -> None:  # noqa: ANN001
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    shared = [make(45) for _ in range(3)]
    texts = [make(rng.randint(5, 90)) for _ in range(12)] + [make(20) + shared[i % 3] + make(9) for i in range(9)]
    texts += [texts[0], texts[13] + shared[0], "xyz " * 200, "", shared[1][:230], make(30) * 2]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[4] * 3), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.report(df, length=240, keep_first=keep_first).collect())
    assert got == brute([(i, t.encode()) for i, t in rows], 240, keep_first)


def test_ranks_follow_the_sort_and_unique_pairs_leave(spark) -> None:  # noqa: ANN001
    rng = random.Random(3)
    pairs = [(rng.randint(0, 40), rng.randint(0, 3)) for _ in range(200)]
    ranked = suffix_dedup.rerank(spark.createDataFrame(pairs, "a long, b long").repartition(5), ["a", "b"]).df.collect()
    again = sorted(p for p, n in collections.Counter(pairs).items() if n > 1)
    assert [(r.a, r.b) for r in sorted(ranked, key=lambda r: r["rank"])] == again


def test_doubling_ties_what_shares_both_halves(spark) -> None:  # noqa: ANN001
    rows = [(1, 0, 7, 8, 1), (2, 0, 7, 8, 2), (3, 0, 7, 9, 3), (4, 0, 9, 8, 4), (5, 0, 9, 8, 4), (6, 0, 5, 5, 9)]
    runs = spark.createDataFrame(rows, "doc_id long, pos int, key0 long, key1 long, e1 long")
    tied, _ = suffix_dedup.doubled(runs)
    got = {r.doc_id: (r.tie, r.mixed) for r in tied.collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[1] == got[2] and got[4] == got[5] and got[1][0] < got[4][0]
    assert got[1][1] and not got[4][1]


def test_a_text_longer_than_a_block(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 700_000, np.uint8).tobytes()
    text = body + body[1000:3000] + b" end"
    df = spark.createDataFrame([(1, text.decode()), (2, body[650_000:650_900].decode())], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.report(df).collect()}
    assert got == {1: (len(text), 2000 * 2 + 900, 3), 2: (900, 900, 1)}
