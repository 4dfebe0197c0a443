"""Filter audit, line dedup and lexical search against brute force on a table with every odd case, and the
queries against DuckDB."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quirework.llm")

from quirework.llm import filter_audit, lexical_search, line_dedup, queries, wavelet  # noqa: E402
from quirework.llm.cuckoo import Cuckoo  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, key string, gone string, row string, score long, rank int, query string"
LAST = 1 << 70


def corpus() -> list[tuple]:
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéK") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [make(6) for _ in range(8)]
    texts = ["\n".join(rng.choice([*common, make(rng.randint(1, 9))]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [None, "", " \n\t \n", "one", "x" * 9 + "\n" + "y" * 10, "Y" * 10 + " \n" + "é" * 9, "É" * 10, "é" * 10, "É" * 10, make(4000), "A & B\n" + make(220), "SHOUT " * 300, "same same " * 150]
    texts += [texts[1], texts[1], texts[3], texts[-3], "  " + common[0].upper() + "\t\r", common[0] + "\n\n" + common[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "another\n" + common[0]), (None, texts[5]), (None, texts[5]), (None, None), (None, "held by none with an id"), (None, "held by none with an id\n?")]
    langs = ["en", "fr", None, ""]
    return [(i, t, langs[k % 4], "s", 1, "clash", 7, "k", "g", "r", 5, 2, "q") for k, (i, t) in enumerate(rows)]


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


# ---------------------------------------------------------------- filter interaction audit


def failed(text: str) -> str:
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    return out + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))


def test_filter_audit(spark, docs, rows, empty):  # noqa: ANN001, ANN201
    said = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 60, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    good, toxic = ({i for i, *v in said if v[k] == 1 and i is not None} for k in (0, 1))
    least: dict[str, int] = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    expected = collections.Counter()
    for part in {r[2] or "" for r in rows}:
        own = [(i, failed(t or "") + "E" * (i is not None and i > least[t or ""])) for i, t, lang, *_ in rows if (lang or "") == part]
        found, shapley = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left, out = own, []
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = sum(f in x[1] for x in own)
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(x[1] == f for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
                out += gone
        expected.update((*x, shapley[x[1][x[2] - 1]]) for x in found)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    result = filter_audit.audit(docs, labels)
    assert result.columns == names and bag(result, *names) == expected
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_filter_audit_with_own_filters(docs):  # noqa: ANN001, ANN201
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    found = filter_audit.audit(docs, labels, {"L": F.length("text") > 20}, "X")
    assert {r["filter_order"] for r in found.collect()} == {"LX", "XL"} and found.filter("step = 2").select("part", "kept").distinct().count() == 3


# ---------------------------------------------------------------- line dedup


def kept_lines(rows: list[tuple]) -> collections.Counter:
    key = lambda line: re.sub("^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: LAST if i is None else i
    held: dict[str, set] = {}
    for n, (i, t, *_) in enumerate(rows):
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add((order(i), n))
    out = collections.Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or order(i) == min(held[key(x)])[0]]
        out[i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    return out


NAMES = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def decided(store, docs, **options):  # noqa: ANN001, ANN003, ANN201
    out = line_dedup.without_dropped(store, docs, **options)
    return bag(out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")), *NAMES)


def test_line_dedup(docs, rows, empty):  # noqa: ANN001, ANN201
    expected = kept_lines(rows)
    assert bag(line_dedup.report(docs), *NAMES) == expected
    assert sum(v for k, v in expected.items() if k[2]) > 20
    assert line_dedup.report(empty).count() == 0
    cut = line_dedup.dedup(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows) and cut.filter("text IS NULL").count() == 2
    store = line_dedup.build(docs, shards=3)
    assert decided(store, docs, most_bytes=0) == expected  # beyond the bound all lines travel
    assert line_dedup.maybe_shared(store.references.df, store).count() < store.references.df.count()


def filter_sizes(store) -> dict[int, int]:  # noqa: ANN001
    return {r["shard"]: n for r in store.filters.df.collect() if (n := Cuckoo(np.frombuffer(bytes(r["slots"]), np.uint16)).size)}


def test_line_dedup_is_reversible(spark, docs, rows):  # noqa: ANN001, ANN201
    """Inserting in parts and deleting again gives the tables and filters of a store built at once."""
    first, second = docs.filter("doc_id % 3 = 0 OR doc_id IS NULL"), docs.filter("doc_id % 3 != 0")
    stored = lambda s: (bag(s.counts.df, "hi", "lo", "refs", "least"), bag(s.references.df, "hi", "lo", "doc_id", "text_key"), filter_sizes(s))
    part, whole = line_dedup.build(first, shards=3), line_dedup.build(docs, shards=3)
    both = line_dedup.insert(part, second)
    assert stored(both) == stored(whole)
    assert decided(both, docs) == kept_lines(rows)
    assert stored(line_dedup.insert(both, second)) == stored(whole)  # what is held already is not counted again
    back = line_dedup.delete(both, second.select("doc_id"))
    assert stored(back) == stored(part)
    assert decided(back, first) == kept_lines([r for r in rows if r[0] is None or r[0] % 3 == 0])
    assert stored(line_dedup.delete(back, first.select("doc_id"))) == (collections.Counter(), collections.Counter(), {})


def test_overflowing_filters_are_built_again(spark, docs, rows):  # noqa: ANN001, ANN201
    lines = [(i, "\n".join(f"a line of its own {k}" for k in range(300))) for i in (1, 2)]
    store = line_dedup.build(spark.createDataFrame([(0, "a line of its own 1"), (9, "a line of its own 1")], "doc_id long, text string"), shards=1)
    then = line_dedup.insert(store, spark.createDataFrame(lines, "doc_id long, text string"))
    assert then.filters.df.count() == 1 and filter_sizes(then) == {0: 300}


def test_cuckoo_filter() -> None:
    rng = np.random.default_rng(5)
    hi, lo, more_hi, more_lo = (rng.integers(-(1 << 63), 1 << 63, 20_000) for _ in range(4))
    own = Cuckoo.of(hi, lo)
    assert own.holds(hi, lo).all() and own.size == 20_000 and own.holds(more_hi, more_lo).mean() < 0.001
    own.remove(hi[:7000], lo[:7000])
    assert own.holds(hi[7000:], lo[7000:]).all() and own.size == 13_000 and own.holds(hi[:7000], lo[:7000]).mean() < 0.001
    assert own.insert(hi[:7000], lo[:7000]) and own.holds(hi, lo).all()
    with pytest.raises(ValueError):
        Cuckoo.of(hi[:10], lo[:10]).remove(hi[10:20], lo[10:20])
    assert not Cuckoo.sized(4).insert(hi[:40], lo[:40])


# ---------------------------------------------------------------- ranked lexical search


def terms_of(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def best_documents(rows: list[tuple], items: list[tuple], k: int) -> collections.Counter:
    docs = [(i, collections.Counter(terms_of(t))) for i, t, *_ in rows if terms_of(t)]
    total, df = sum(sum(c.values()) for _, c in docs), collections.Counter(t for _, c in docs for t in c)
    out = collections.Counter()
    for item, text in set(items):
        found = []
        for i, c in docs:
            n = sum(c.values())
            m = 100 - 75 + 75 * n * len(docs) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            found += [(-score, LAST if i is None else i)] * (score > 0)
        out.update((item, r, None if i == LAST else i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1))
    return out


def test_lexical_search(spark, docs, rows, empty):  # noqa: ANN001, ANN201
    rng = random.Random(3)
    every = sorted({w for r in rows for w in terms_of(r[1])})
    items = [(i, " ".join(rng.choice(every) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "zzzzz"), (33, "same SAME Same"), (33, "same SAME Same"), (None, rows[9][1]), (34, rows[1][1]), (35, "é! held,by;none")]
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int")
    names = ["item_id", "rank", "doc_id", "score"]
    for k in (10, 3):
        assert bag(lexical_search.rank(docs, asked, k), *names) == best_documents(rows, items, k)
    n, total = lexical_search.totals(docs)
    small = lexical_search.build_index(docs, n, total, shard_tokens=40, chunk=50)  # many shards, single documents among them
    assert small.df.count() > 20
    assert bag(lexical_search.search(small.df, asked, n, most_bytes=200), *names) == best_documents(rows, items, 10)  # several parts of queries
    assert lexical_search.rank(empty, asked).count() == 0 and lexical_search.rank(docs, asked.limit(0)).count() == 0


def test_copies_share_a_score(spark):  # noqa: ANN001, ANN201
    """Thousands of equal documents: the least ids win, in whatever shard they are."""
    docs = spark.range(4000).select((F.col("id") * 7 % 4001).alias("doc_id"), F.when(F.col("id") % 2 == 0, "tie tie word").otherwise("other").alias("text")).repartition(5)
    asked = spark.createDataFrame([(1, "tie"), (2, "word other")], "item_id long, text string")
    ids = sorted(i * 7 % 4001 for i in range(0, 4000, 2))[:10]
    found = lexical_search.rank(docs, asked).filter("item_id = 1").orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == ids


def test_lists_stay_in_order_of_impact_below_any_node() -> None:
    rng = np.random.default_rng(1)
    docs, terms = np.repeat(np.arange(37), 6), np.tile(np.arange(6, dtype=np.uint64), 37)
    packed = wavelet.pack(terms, docs, rng.integers(1, 9, len(docs)), rng.integers(30, 300, 37), np.arange(37), 0)
    tree = wavelet.Tree(packed)
    begin, end = tree.lists(np.arange(6, dtype=np.uint64))
    assert all((np.diff(tree.impact[0][b:e]) <= 0).all() and e - b == 37 for b, e in zip(begin, end, strict=True))
    nodes = wavelet._bounded(tree, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(6, np.int64), begin, end, np.ones(6, np.int64))
    while nodes.level[0] < tree.levels:
        nodes = wavelet._children(tree, nodes)
        level = np.repeat(nodes.level, nodes.size)
        assert all((np.diff(tree.impact[v][b:e]) <= 0).all() for v, b, e in zip(level, nodes.begin, nodes.end, strict=True))
    assert sorted(nodes.prefix) == list(range(37)) and (nodes.end - nodes.begin == 1).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):  # noqa: ANN001, ANN201
    duck = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = duck.sql(queries.ORACLES[name])
    ours = queries.QUERIES[name](spark, SF)
    assert collections.Counter(tuple(r[c] for c in theirs.columns) for r in ours.collect()) == collections.Counter(theirs.fetchall())
