"""Each operator against a brute-force version on a small table with every odd case: null and empty
texts, white space only, repeated rows, copies, near copies, long texts, a null id, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quirework.llm")

import corpus_pipeline  # noqa: E402
from quirework.llm import ann, decontaminate, jaccard_join, langid, lm, packing, quality, substring_dedup, suffix_dedup, toxicity  # noqa: E402
from quirework.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, text_key string, word string"


def corpus() -> list[tuple]:
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = make(90)
    texts = [make(rng.randint(1, 160)) for _ in range(30)] + [make(40) + "\n" + passage + " " + make(30) for _ in range(6)]
    texts += [texts[2], texts[2], texts[33], texts[33] + " tail", texts[5] + " x", texts[5].upper(), "a" * 1500, "ab " * 700, passage[:450]]
    texts += [None, "", " \n\t ", "one", "one two three", "É", "12 34", make(4000), make(6) * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (7, "another text of seven " + passage), (None, texts[4]), (None, None)]
    return [(i, t, "en" if i is not None and i % 3 else None, "s", len(t or ""), "clash", 1, "k", "w") for i, t in rows]


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([], SCHEMA)


def bag(df, *names):  # noqa: ANN001, ANN002, ANN201
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


def test_suffix_dedup(docs, rows, empty):  # noqa: ANN001, ANN201
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    expected = collections.Counter()
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        expected[r[0], len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert bag(suffix_dedup.report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert suffix_dedup.report(empty).count() == 0
    cut = suffix_dedup.dedup(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_substring_dedup(docs, rows, empty):  # noqa: ANN001, ANN201
    least: dict[tuple, tuple] = {}
    order = lambda i: (i is not None, i or 0)
    split = [(r[1] or "").encode().split() for r in rows]
    for r, w in zip(rows, split, strict=True):
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            least[k] = min(least.get(k, ((9,), 0)), (order(r[0]), p))
    expected = collections.Counter()
    for r, w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if least[tuple(w[p : p + 20])] < (order(r[0]), p):
                gone[p : p + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert bag(substring_dedup.report(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    assert substring_dedup.report(empty).count() == 0


def sets_of(rows: list[tuple]) -> list[frozenset]:
    out = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def test_jaccard_join(docs, rows, empty):  # noqa: ANN001, ANN201
    sets = sets_of(rows)
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = collections.defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        ids[g].append(r[0])
    name = lambda g: min([i for i in ids[g] if i is not None], default=None)
    expected = collections.Counter((r[0], len(s), name(g) if s else r[0]) for r, s, g in zip(rows, sets, group, strict=True))
    assert bag(jaccard_join.linked(docs), "doc_id", "n_shingles", "component_id") == expected
    assert jaccard_join.linked(empty).count() == 0


def test_components(spark):  # noqa: ANN001, ANN201
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 150), (300, 300)]
    found = components(spark.createDataFrame(chain, "a long, b long"), "test").df
    got = {r.node: r.root for r in found.collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[150] == got[100] == 100


def test_packing(docs, rows, empty):  # noqa: ANN001, ANN201
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    expected = collections.Counter()
    for r in rows:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n in packing.pieces_of(len(ids)):
            assert n & (n - 1) == 0 and n <= 4096
            expected[r[0], at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), 0] += 1
            at += n
        assert at == len(ids)
    found = packing.pack(docs)
    assert bag(found, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset") == expected
    assert found.select("sequence_id").distinct().count() == sum(expected.values())
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["don't STOP <|endoftext|> ok", "ΑΣ ας İx ﬁ ﬀ", "a b\u0085c x́y", "½²³ 12ab", "naïve café", "日本語 テスト", "..,!? --", "Œuvre œ"])
def test_word_ids_are_the_tokenizers(text):  # noqa: ANN001, ANN201
    ids = packing.WordIds(packing.default_tokenizer())
    got = np.frombuffer(b"".join(ids[w] for w in text.encode().split()), "<u4").tolist()
    assert got == ids.whole.encode(text, add_special_tokens=False).ids


def test_lm(docs, rows, empty):  # noqa: ANN001, ANN201
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    tokens = [[*(r[1] or "").encode().lower().split(), None] for r in rows]
    c: collections.Counter = collections.Counter()
    for r, t in zip(rows, tokens, strict=True):
        if fold(r[0]) != 2:
            c.update(t)
    n, v = sum(c.values()), len(c)
    expected = collections.Counter((r[0], fold(r[0]) == 2, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 5)) for r, t in zip(rows, tokens, strict=True))
    found = lm.score(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == expected
    assert all(r.score < 0 for r in found)
    assert lm.score(empty).count() == 0


def test_classes_are_a_distribution():  # noqa: ANN201
    data = np.frombuffer(b"the THE x thing", np.uint8)
    from quirework.llm.common import Words

    k = lm.spelling(data, Words(data, np.array([0, len(data)]), lower=True))
    assert k[0] == k[1] and (k > lm.END_CLASS).all() and (k < lm.CLASSES).all()


def test_neighbours(spark):  # noqa: ANN001, ANN201
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:130] = x[0]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (950, [0.0] * 16), (1000, [float("nan")] * 16), (1050, [None] * 16), (1100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, block=100, queries=3, share=1.0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 700, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        top = np.lexsort((np.arange(700), -s))[:5].tolist()
        mine = sorted(got[q])
        hits += len(set(top) & {m[1] for m in mine})
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
    assert hits >= 0.95 * 70 and set(got) == set(range(0, 700, 50))
    assert [m[1] for m in sorted(got[0])] == [100, 101, 102, 103, 104]
    assert ann.search(df.filter("vec_id > 800"), F.col("vec_id") % 50 == 0).count() == 0


def test_decontamination(spark, empty):  # noqa: ANN001, ANN201
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [make(rng.randint(12, 40)) + ". " + make(rng.randint(3, 9)) + "." for _ in range(30)]
    docs = [(i, make(600)) for i in range(20)] + [(100 + i, make(200) + " " + t.upper().replace(".", " ,") + " " + make(150)) for i, t in enumerate(items)] + [(500, items[0].split(".")[0]), (501, None), (502, "")]
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*enumerate(items), (77, None), (78, "")], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(100 + i, i) for i in range(30)}
    assert decontaminate.find(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_classifiers_on_odd_rows(spark, docs, rows, empty):  # noqa: ANN001, ANN201
    sample = spark.createDataFrame([(t, int("moron" in t)) for t in [f"word{i % 9} is x{i % 11} {w} y{i % 13} thing" for i in range(120) for w in ("moron", "plain", "good")]], "text string, label int")
    field = toxicity.fit(sample)
    got = toxicity.score(docs.limit(0).union(docs), field, [F.col("doc_id")]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and not r.spans for r in got)
    bad = toxicity.score(spark.createDataFrame([("you MORON!",), ("fine",)], "text string"), field, [F.col("text")]).collect()
    assert {r.row.text: r.predicted for r in bad} == {"you MORON!": 1, "fine": 0}
    assert [(s.start, s.bytes) for r in bad for s in r.spans] == [(4, 5)]
    model = quality.fit(spark.createDataFrame([("a a a a a a a a a", 0), ("one fine text of many words", 1)] * 40, "text string, label int"))
    scored = quality.score(docs, model, [F.col("doc_id")]).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(empty, quality.fit(sample.limit(0)), [F.col("doc_id")]).count() == 0
    langs = langid.fit(spark.createDataFrame([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 40, "text string, label string").withColumn("doc_id", F.monotonically_increasing_id()))
    told = langid.predict(docs, langs, [F.col("doc_id"), F.col("text")]).collect()
    assert all((r.lang_pred == "und") == (r.row.text is None or not any(c.isalpha() for c in r.row.text)) for r in told) and len(told) == len(rows)


def test_marginals_are_exact():  # noqa: ANN201
    rng = np.random.default_rng(0)
    u, moves, start = rng.normal(size=9) * 2, rng.normal(size=(2, 2)), 0.3
    fresh = np.zeros(9, bool)
    fresh[[0, 4]] = True
    brute = np.zeros(9)
    for lo, hi in ((0, 4), (4, 9)):
        total, on = 0.0, np.zeros(hi - lo)
        for code in range(1 << (hi - lo)):
            y = [code >> i & 1 for i in range(hi - lo)]
            w = math.exp(start * y[0] + sum(u[lo + i] * y[i] for i in range(hi - lo)) + sum(moves[y[i], y[i + 1]] for i in range(hi - lo - 1)))
            total += w
            on += w * np.array(y)
        brute[lo:hi] = on / total
    assert np.allclose(toxicity.marginals(u, fresh, start, moves, depth=4), brute)


def test_pipeline_keeps_columns(spark, docs, tmp_path):  # noqa: ANN001, ANN201
    import os

    spark.createDataFrame([(1, "some item of words that nobody holds at all. really none.")], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    now = docs.filter("doc_id is not null")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, now, str(tmp_path))
        path = os.path.join(tmp_path, name)
        out.write.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
            now = spark.read.parquet(path)
            assert now.count() > 0
