"""Splitting against counting every prefix anew, nested values against a recursive walk."""

from __future__ import annotations

import json
import random
import re

from quirework.functions import nested
from quirework.functions.split import BOUNDARIES, CJK, SIGN, WORD, Scan, split_at


def counted(text: str) -> int:
    return max(1, len(re.findall(WORD, text)) + (len(re.findall(CJK, text)) + 1) // 2 + len(re.findall(SIGN, text)) // 4)


def pieces(text: str, most: int) -> list[str]:
    out, rest = [], text.strip()
    while counted(rest) > most and rest:
        fits = max((n for n in range(1, len(rest)) if counted(rest[:n]) <= most), default=1)
        good = [n for n in range(max(1, int(fits * 0.55)), fits + 1) if rest[n - 1] in BOUNDARIES]
        cut = max(good, default=fits)
        out += [rest[:cut].rstrip()] if rest[:cut].strip() else []
        rest = rest[cut:].lstrip()
    return out + [rest] * bool(rest)


def test_pieces_are_those_of_counting_anew() -> None:
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["word", "a", "é", "日", "。", " ", "\n", ",", "--", "_", "9", "\t", "::"]) for _ in range(rng.randint(0, 60)))
        for most in (1, 2, 5, 11):
            assert split_at(text, most) == pieces(text, most), (text, most)
        a = rng.randint(0, len(text))
        b = rng.randint(a, len(text))
        assert Scan(text).tokens(a, b) == counted(text[a:b])


def test_long_texts_take_one_scan() -> None:
    text = "some words, and more of them. " * 20_000
    found = split_at(text, 100)
    assert sum(map(len, found)) > 500_000 and max(map(counted, found)) <= 100


def test_values_at_any_depth(spark):  # noqa: ANN001, ANN201
    rng = random.Random(1)

    def made(depth: int):  # noqa: ANN202
        pick = rng.random()
        if depth == 0 or pick < 0.3:
            return rng.choice([None, True, 3, 2.5, "s", "", 1 << 70, -5])
        return [made(depth - 1) for _ in range(rng.randint(0, 3))] if pick < 0.6 else {rng.choice("abcdef") + str(i): made(depth - 1) for i in range(rng.randint(0, 3))}

    def walk(value, path=()):  # noqa: ANN001, ANN202
        items = sorted(value.items()) if isinstance(value, dict) else [(None, x) for x in value] if isinstance(value, list) else []
        for i, (name, x) in enumerate(items):
            yield (*path, i), path, name, x if isinstance(x, str) else None, x if type(x) is int and abs(x) < 1 << 63 else None
            yield from walk(x, (*path, i))

    deep: object = "bottom"
    for _ in range(60):
        deep = {"in": [deep]}
    bodies = [made(5) for _ in range(60)] + [deep]
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(900, None), (901, "{"), (902, "[NaN]"), (903, ""), (904, "7")]
    found = sorted(((r["k"], tuple(r["path"]), tuple(r["parent"]), r["name"], r["text"], r["whole"]) for r in nested.values(spark.createDataFrame(rows, "k int, body string"), "k", "body").collect()), key=str)
    assert found == sorted(((i, *x) for i, b in enumerate(bodies) for x in walk(b)), key=str)
    kinds = {r["kind"] for r in nested.values(spark.createDataFrame(rows, "k int, body string"), "k", "body").collect()}
    assert kinds == {"object", "array", "string", "integer", "number", "boolean", "null"}


def test_secrets_and_pages_of_bodies(spark):  # noqa: ANN001, ANN201
    """One row a key, whatever its bodies hold; keys without values have none."""
    deep = '{"page": 0, "a": {"page": 9, "page_number": 4}, "b": [{"API_Key": 1, "page_number": 2}]}'
    rows = [(1, deep), (2, '{"x": [1, true]}'), (2, '{"references_start": 7}'), (3, None), (4, "{"), (5, "[]"), (6, '{"My_Password": null, "page": true}')]
    df = spark.createDataFrame(rows, "k int, body string")
    assert {r["k"]: r["secret"] for r in nested.contains_secret(df, "k", "body").collect()} == {1: True, 2: False, 6: True}
    assert {r["k"]: r["page"] for r in nested.first_page(df, "k", "body").collect()} == {1: 4, 2: 7}


def test_values_come_in_slices(spark):  # noqa: ANN001, ANN201
    """Values of a batch are handed over a slice at a time, not as one list for the batch; none is lost."""
    import pyarrow as pa

    texts = ['{"text": "' + "x" * (1 << 16) + '"}'] * 50 + [None, ""]
    held = list(nested._slices(pa.array(texts)))
    assert len(held) > 10 and [t for _, part in held for t in part] == texts
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string").coalesce(1)
    assert nested.values(df, "k", "body", ("text",)).agg({"text": "count"}).first()[0] == 50
