"""Literal cases that the driver's tables don't hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirework.functions import geometry as G
from quirework.functions import text as X
from quirework.operators import aggregates as A
from quirework.operators import relational as R
from quirework.operators.containment import containing


def one(spark, column, **values):  # noqa: ANN001, ANN003, ANN201
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("re-\nsult", "result"), ("one\ntwo", "one two"), ("end.\nnext", "end.\nnext"), ("ﬁne １２", "fine 12"), ("a\r\n\r\n\r\n\r\nB", "a\n\nB"), ("so­ft", "soft"), (None, "")],
)
def test_prose(spark, text, expected):  # noqa: ANN001, ANN201
    assert one(spark, X.normalize_prose(F.col("t")), t=text) == expected


@pytest.mark.parametrize(("text", "expected"), [("1.50 and 5%", ["1.5", "5%"]), ("v2.0 x3 -4 +007.10", ["-4", "7.1"]), ("100 1,5", ["100", "1", "5"]), ("0.0", ["0"])])
def test_numbers(spark, text, expected):  # noqa: ANN001, ANN201
    assert one(spark, X.numbers_in(F.col("t")), t=text) == expected


def test_terms(spark):  # noqa: ANN001, ANN201
    got = set(one(spark, X.question_terms(F.col("t")), t="本文的方法 uses BERT-base at 3.5%?"))
    assert {"uses", "bert-base", "at", "3.5%", "本文的方法", "本文", "方法", "文的方"} <= got


def test_tokens_and_flags(spark):  # noqa: ANN001, ANN201
    assert one(spark, X.estimate_tokens(F.col("t")), t="方法 abc déf !!!!") == 5
    assert one(spark, X.quality_flags(F.col("t"), True), t="  ") == ["empty_text"]
    assert one(spark, X.quality_flags(F.col("t")), t="a b c d e f g �") == ["replacement_character", "possible_spaced_ocr_text"]


def test_uuid5(spark):  # noqa: ANN001, ANN201
    import uuid

    for name in ("a", "x|y|z", "é"):
        assert one(spark, X.uuid5_url(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_markdown(spark):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([([["a|b", "c"], ["d"]],)], "m array<array<string>>")
    assert df.select(X.matrix_to_markdown(F.col("m"))).first()[0] == "| a\\|b | c |\n| --- | --- |\n| d |  |"


def test_boxes(spark):  # noqa: ANN001, ANN201
    df = spark.sql("select named_struct('x0', 0D, 'y0', 0D, 'x1', 10D, 'y1', 10D) a, named_struct('x0', 5D, 'y0', 5D, 'x1', 15D, 'y1', 15D) b, named_struct('x0', 1D, 'y0', 1D, 'x1', 1D, 'y1', 1D) z")
    got = df.select(G.overlap(df.a, df.b), G.iou(df.a, df.b), G.coverage(df.z, df.a), G.centre_inside(df.b, df.a)).first()
    assert (got[0], round(got[1], 6), got[2], got[3]) == (25.0, round(25 / 175, 6), 0.0, True)


def test_scope_is_all_or_nothing(spark):  # noqa: ANN001, ANN201
    owned = spark.createDataFrame([(1,), (2,)], "k long")
    assert R.authorised(owned, spark.createDataFrame([(1,)], "k long"), "k").count() == 1
    assert R.authorised(owned, spark.createDataFrame([(1,), (3,)], "k long"), "k").count() == 0


def test_verdict_before_severity(spark):  # noqa: ANN001, ANN201
    rows = [(1, "compliant", "high", "a", 1, 1, True), (1, "non_compliant", "low", "b", 3, 2, True), (1, "non_compliant", "medium", "c", 2, 3, False)]
    got = A.consolidate(spark.createDataFrame(rows, "rule_id long, result string, severity string, finding string, unit_position long, evidence_id long, complete boolean")).first()
    assert (got.result, got.severity, got.finding, got.evidences, got.complete, got.unit_position) == ("non_compliant", "medium", "c", 2, False, 2)


def test_binned_mode_ties(spark):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([("p", 1.0), ("p", 1.0), ("p", 9.0), ("p", 9.4)], "k string, v double")
    assert A.binned_mode(df, ["k"], "v", 2.0).first()["binned_mode"] == 1.0


def test_containment_of_short_needles(spark):  # noqa: ANN001, ANN201
    texts = spark.createDataFrame([(1, "x one two three y"), (2, "zone twofold")], "id long, t string")
    needles = spark.createDataFrame([(7, "one two three"), (8, "one tw"), (9, "none here at all")], "n long, needle string")
    assert {(r.id, r.n) for r in containing(texts, needles, "t", "needle").collect()} == {(1, 7), (1, 8), (2, 8)}


def test_replay(spark):  # noqa: ANN001, ANN201
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, request_hash string")
    kept = spark.createDataFrame([(1, "a", "{}"), (2, "x", "{}")], "k long, request_hash string, response string")
    assert {r.k: r.outcome for r in R.replay(asked, kept, ["k"]).collect()} == {1: "replay", 2: "conflict", 3: "proceed"}
