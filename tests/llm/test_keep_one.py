"""One row of each group of near copies goes on, whatever its ids, and keeps its text."""

from __future__ import annotations

import collections
import random

import pytest

pytest.importorskip("quirework.llm")

import corpus_pipeline  # noqa: E402

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_each_group(spark):  # noqa: ANN001, ANN201
    """Equal rows, rows equal in doc_id and text alone, components without ids, mixed ones, and texts without words."""
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120))
    same, other, unnamed, mixed, alone = (text() for _ in range(5))
    rows = [(1, same, "en", "s")] * 3 + [(2, other, "en", "s"), (2, other, "de", "t")]
    rows += [(None, unnamed, "en", "s")] * 2 + [(None, unnamed + " tail", "en", "s")]
    rows += [(None, mixed, "en", "s"), (9, mixed + " tail", "en", "s"), (8, mixed, "en", "s"), (4, alone, "en", "s")]
    rows += [(5, "", "en", "s"), (5, "", "en", "s"), (None, None, "en", "s")]
    docs = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], TABLE).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    either = [t for t in (unnamed, unnamed + " tail") if got[(None, t)]]
    assert len(either) == 1
    assert got == collections.Counter([(1, same), (2, other), (None, either[0]), (8, mixed), (4, alone), (5, ""), (5, ""), (None, None)])
    cut = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.repeated_bytes(spark, kept, "").collect())
    assert cut == got  # nothing repeats any more, so no text loses a byte
