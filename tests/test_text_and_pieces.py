"""Literals of sort keys, formulas, visual lines and columns; JSON fields however the text is cut."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quirework.functions import text as X
from quirework.operators.columns import column_geometry
from quirework.operators.order import visual_lines
from quirework.streaming import json_field as J

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def values(spark, f, texts):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_sort_keys(spark):  # noqa: ANN001, ANN201
    names = {"K¨arkk¨ainen": "k~arkk~ainen", "Kärkkäinen": "karkkainen", "O'Brien-Smith": "obriensmith", "Strauß": "strauss", "ÅNGSTRÖM": "angstrom", "¨": "~", "42": None, "": None, "李": None, "van der Berg": "vanderberg", "ﬁsh": "fish"}
    assert values(spark, X.sort_key, [*names, None]) == [*names.values(), None]


def test_formula_spacing(spark):  # noqa: ANN001, ANN201
    rules = {
        r"\alpha x": r"\alpha x", r"\mathrm  a b c": r"\mathrm abc", "s o f t m a x": "softmax", "x _ i": "x_i", "x _{ i }": "x_{ i }", r"a \_ b": r"a\_b", "x_ i": "x_i", "x_ {i}": "x_{i}", r"a\_ b": r"a\_b",
        "1. 5": "1.5", "1. 2. 3": "1.2.3", "{ - 3}": "{-3}", "^ - 2": "^-2", "- 4": "-4", "a + b": "a + b", "": "", "2 - x": "2 - x",
    }
    assert values(spark, X.formula_spacing, list(rules)) == list(rules.values())


def test_keys_fold_sharp_s(spark):  # noqa: ANN001, ANN201
    assert values(spark, X.letters_key, ["Straße, GROẞ!", None, "a_b 1"]) == ["strassegross", "", "a_b1"]


def test_lines_are_anchored_at_their_first_fragment(spark):  # noqa: ANN001, ANN201
    given = [(1, "c", 0.0), (1, "a", 0.9), (1, "b", 1.8), (1, "d", 2.8), (1, "e", 2.81), (1, "f", 50.0), (2, "g", None), (2, "h", 9.5)]
    rows = [(p, t, (10.0 * (5 - i), 0.0, 10.0 * (5 - i) + 5, 9.0), b) for i, (p, t, b) in enumerate(given)]
    df = spark.createDataFrame(rows, f"page int, text string, box {BOX}, baseline double")
    found = [(r["page"], r["line"], r["text"], r["baseline"], r["fragments"]) for r in visual_lines(df, ["page"]).orderBy("page", "line").collect()]
    assert found == [(1, 1, "a c", 0.45, 2), (1, 2, "d b", 2.3, 2), (1, 3, "e", 2.81, 1), (1, 4, "f", 50.0, 1), (2, 1, "h g", 9.25, 2)]
    assert visual_lines(df.limit(0), ["page"]).count() == 0


def test_columns_and_their_gutter(spark):  # noqa: ANN001, ANN201
    text = "twenty characters of body text"
    line = lambda d, p, i, x0, x1, size=10.0, t=text: (d, p, i, i, t, x0, 100.0 + 12 * i, x1, 110.0 + 12 * i, None, size, "F", 600.0, 800.0, None)
    rows = [line(1, 1, i, 50.0, 290.0) for i in range(6)] + [line(1, 2, i, 310.0, 550.0) for i in range(6)] + [line(1, 2, 9, 200.0, 500.0, 14.0), line(1, 2, 10, 60.0, 290.0, 10.0, "short")]
    rows += [line(2, 1, i, 50.0, 550.0, 9.0 if i < 3 else 10.0) for i in range(6)] + [line(3, 1, 1, 5.0, 100.0)]
    df = spark.createDataFrame(rows, "doc_id int, page int, line_id int, native_id int, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double, font string, width double, height double, body_end int")
    found = {r["doc_id"]: r for r in column_geometry(df, ["doc_id"]).collect()}
    assert set(found) == {1, 2}  # a document without body lines has no row
    a, b = found[1], found[2]
    assert (a["columns"], a["left_start"], a["left_end"], a["right_start"], a["right_end"], a["text_width"], a["column_width"], a["gutter"], a["ink_gap"], a["lines"]) == (2, 50.0, 290.0, 310.0, 550.0, 500.0, 240.0, 20.0, 20.0, 12)
    assert (b["columns"], b["body_size"], b["lines"], b["gutter"], b["confidence"]) == (1, 9.0, 3, None, 0.7)  # of sizes with equal weight the first


# ---------------------------------------------------------------- JSON fields

WHOLE = {
    '{"a": 1, "answer": "plain", "b": "x"}': "plain", '{"answer" : "q\\"uote \\\\ \\n\\t\\/ end"}': 'q"uote \\ \n\t/ end', '{"answer":"\\u00e9\\ud83d\\ude00!"}': "é😀!", '{"answer":"\\ud83d x\\ude00\\ud83d\\ud83d\\ude00"}': "� x��😀",
    '{"answer":"\\uzzzz\\q"}': "\\uzzzzq", '{"answer": null, "b": "next"}': "b", '{"other": "x"}': "", '{"answer":"open \\u00': "open ", '{"answer":"open \\': "open ", '{"ans': "", '{"xanswer": "no", "answer": ""}': "", '{"answer":"\\ud83d"}': "�",
}


def test_any_cutting_gives_the_same_field() -> None:
    rng = random.Random(4)
    for text, value in WHOLE.items():
        for _ in range(60):
            cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 12)))
            place, out = J.Place(), ""
            for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
                place, delta = J.advance(place, text[a:b], "answer")
                out += delta
            assert out == value, text


def test_field_is_what_json_says() -> None:
    rng = random.Random(9)
    for _ in range(300):
        value = "".join(rng.choice('ab"\\\n\té😀/u0{}:,') for _ in range(rng.randint(0, 40)))
        text = json.dumps({"x": 1, "answer": value, "answer2": "no"}, ensure_ascii=rng.random() < 0.5)
        place, out = J.Place(), ""
        while text:
            n = rng.randint(1, 9)
            place, delta = J.advance(place, text[:n], "answer")
            out, text = out + delta, text[n:]
        assert out == value


def test_pieces_in_batch_and_stream(spark, tmp_path):  # noqa: ANN001, ANN201
    rows = [(k, i, text[i : i + 3]) for k, text in enumerate(WHOLE) for i in range(0, len(text), 3)] + [(None, 0, '{"answer":"of null'), (None, 1, 'ity"}'), (99, 0, None)]
    expected = dict(enumerate(WHOLE.values())) | {None: "of nullity", 99: ""}
    df = spark.createDataFrame(rows, "key long, at long, piece string").repartition(3)
    found = {r["key"]: r["value"] for r in J.whole_field(J.field_pieces(df, "key", "at", "piece", "answer"), "key", "at").collect()}
    assert found == expected
    assert J.field_pieces(df.limit(0), "key", "at", "piece", "answer").count() == 0
    for part, (low, high) in enumerate([(0, 9), (9, 24), (24, 999)]):  # three batches, which cut escapes
        df.filter((F.col("at") >= low) & (F.col("at") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={part}"))
    stream = spark.readStream.schema("key long, at long, piece string, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = J.field_stream(stream, "key", "at", "piece", "answer").writeStream.format("memory").queryName("fields").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r["key"]: r["value"] for r in J.whole_field(spark.table("fields"), "key", "at").collect()}
    assert got == expected
