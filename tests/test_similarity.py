"""Every pair of adjacent lines is scored, whatever the lengths."""

from __future__ import annotations

import difflib
import random

import quirework.queries  # noqa: F401
from quirework.functions.udfs import shared_ratio
from quirework.registry import QUERIES


def test_all_adjacent_pairs(spark, tmp_path):  # noqa: ANN001, ANN201
    """A line far shorter than the other that holds it, lines of 200 characters and more, and case and signs alone."""
    long = " ".join(f"word{i}" for i in range(60))
    text = "\n".join(["ab", "ab " + "c" * 38, "abcd", "abce", "AB-CE!", long, long + " end", "--"])
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["block_no"]: r["similarity"] for r in QUERIES["X14_text_similarity"](spark, str(tmp_path)).collect()}
    n = len(long.replace(" ", ""))
    assert sorted(found) == [1, 2, 3, 4, 5, 6, 7]
    assert found[1] == 0.05 and found[3] == 0.75 and found[4] == 1.0
    assert found[6] == round(n / (n + 3), 6) and found[7] == 0.0


def test_ratio_is_difflibs():  # noqa: ANN201
    """Few and many letters, frequent ones in texts of 200 characters and more, empty texts, shared stretches."""
    pick = random.Random(4)
    for _ in range(1500):
        letters = pick.choice(["ab", "abcdefghij", "etaoinshrdlucmfwyp" * 4 + "qxz", "etaoin" * 20 + "qzxj"])
        a, b = ("".join(pick.choices(letters, k=pick.choice([0, 1, 5, 40, 150, 199, 200, 300]))) for _ in "ab")
        b = b[:50] + a[20 : 20 + pick.choice([0, 60])] + b[50:]
        for autojunk in (True, False):
            want = difflib.SequenceMatcher(None, a, b, autojunk).ratio()
            assert shared_ratio(a, b, autojunk) == want
            assert shared_ratio(a, b, autojunk, 0.55) == want if want >= 0.55 else shared_ratio(a, b, autojunk, 0.55) in (0.0, want)


def test_ratio_searches():  # noqa: ANN201
    """Texts that share no character beyond the first region cost one search a character, not a table of all places."""
    class Counted(str):
        asked = 0

        def find(self, *args):  # noqa: ANN002, ANN202
            Counted.asked += 1
            return super().find(*args)

    assert shared_ratio("a" * 150, Counted("b" * 150)) == 0.0 and Counted.asked == 150
