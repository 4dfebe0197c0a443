"""The HTML table model, number and citation checks, rule ids and listings against literals."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from quirework.functions import text as X
from quirework.functions.udfs import table_matrix
from quirework.plans import validation as V
from quirework.sources import files


def test_spans_take_slots() -> None:
    html = "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td colspan=2>d</td></tr></table>"
    assert table_matrix(html) == [["a", "b"], ["a", "c"], ["d", "d"]]
    assert table_matrix(html, fill=False) == [["a", "b"], ["", "c"], ["d", ""]]


def test_rowspan_zero_and_row_groups() -> None:
    html = "<table><thead><tr><th rowspan=0>h</th><th>i</th></tr></thead><tbody><tr><td rowspan=9>x</td><td>y</td></tr><tr><td>z</td></tr></tbody></table>"
    assert table_matrix(html) == [["h", "i"], ["x", "y"], ["x", "z"]]


def test_left_out_end_tags_breaks_and_inner_tables() -> None:
    assert table_matrix("<table><tr><td>a<br>b<td>c &amp; d<tr><td><table><tr><td>in</td></tr></table>side</table>") == [["a b", "c & d"], ["inside", ""]]


@pytest.mark.parametrize("html", [None, "", "no table", "<table></table>", "<table><tr></tr></table>"])
def test_nothing_to_lay_out(html: str | None) -> None:
    assert table_matrix(html) == []


def test_wide_tables_keep_all_columns_and_absurd_ones_raise() -> None:
    assert len(table_matrix("<table><tr>" + "<td>x</td>" * 12_000 + "</tr></table>")[0]) == 12_000
    with pytest.raises(ValueError):
        table_matrix("<table><tr><td colspan=9000000>x</td></tr></table>")


def test_numbers_without_ids(spark) -> None:  # noqa: ANN001
    rows = [("Loss fell 12.50% (paper-3, paper-31) to 4", ["paper-3", "paper-31"], "12.5% of 9", "7"), ("score 7 of 10", [], "", "7 10")]
    df = spark.createDataFrame(rows, "text string, ids array<string>, quote string, score string")
    out = df.select(V.unsupported_numbers(F.col("text"), F.col("ids"), X.numbers_in(F.col("quote")), X.numbers_in(F.col("score"))).alias("n")).collect()
    assert [r.n for r in out] == [["4"], []]


def test_uuid5_is_pythons(spark) -> None:  # noqa: ANN001
    names = ["", "venue:initial:1", "é:模式"]
    got = [r.u for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.uuid5(uuid.NAMESPACE_URL.hex, F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_every_citation_error(spark) -> None:  # noqa: ANN001
    answers = spark.createDataFrame([(1, "review", False, True), (2, "score", False, False), (3, "score", True, False), (4, "question", False, True)], "answer_id long, route string, refusal boolean, scored boolean")
    evidence = spark.createDataFrame([(1, 10, "paper"), (1, 11, "standard"), (2, 20, "paper"), (4, 40, "paper")], "answer_id long, evidence_id long, source string")
    claims = spark.createDataFrame([(1, 1, "positive", 10), (1, 2, "positive", None), (1, 3, "positive", 99), (1, 4, "positive", 11), (2, 1, "negative", None), (4, 1, "positive", 40)], "answer_id long, claim_id long, kind string, evidence_id long")
    declared = spark.createDataFrame([(1, 10), (1, 77), (4, 40)], "answer_id long, evidence_id long")
    score = spark.createDataFrame([(1, 98), (4, 40)], "answer_id long, evidence_id long")
    got = {(r.answer_id, r.claim_id, r.error, tuple(r.ids)) for r in V.citation_errors(answers, claims, evidence, declared, score).collect()}
    assert got == {
        (1, None, "answer_declares_unknown", (77,)), (1, 1, "claim_without_standard", ()), (1, 2, "claim_uncited", ()), (1, 3, "claim_cites_unknown", (99,)), (1, 4, "claim_without_paper", ()), (1, 4, "claim_beyond_declared", ()),
        (1, None, "score_cites_unknown", (98,)), (2, 1, "claim_without_standard", ()), (2, None, "score_missing", ()), (4, None, "score_beyond_standards", ()),
    }


def test_run_listing_reads_a_folder(spark, tmp_path) -> None:  # noqa: ANN001
    for name in ("b/x.json", "b/deep/y.json", "a/z.bin", "loose.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path")
    assert {(r.run, r.file_count) for r in files.run_counts(paths, f"file:{tmp_path}").collect()} == {("a", 1), ("b", 2)}
