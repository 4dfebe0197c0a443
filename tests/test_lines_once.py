"""Statistics of a document's lines come from lines that are laid out and keyed once, not once for each statistic."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quirework.operators.columns import body_geometry, column_geometry


@pytest.mark.parametrize(("name", "reads"), [("A15_document_columns", 1), ("A16_document_body", 1), ("S11_native_blocks", 1), ("A37_profile_assessment", 2), ("R07_review_units", 1), ("R07_unit_members", 1), ("R08_refined_units", 2)])
def test_lines_are_laid_out_once(spark, name, reads):  # noqa: ANN001, ANN201
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == reads
    assert plan.count("ArrowEvalPython") == (1 if name[0] == "A" else 0)


def test_documents_of_odd_lines(spark):  # noqa: ANN001, ANN201
    """No font, no baseline, no document; equal tops; a size that is halved by weight."""
    line = lambda doc, page, i, size, font, y0, baseline: (doc, page, i, 1, "words that are long enough to count", 72.0 + i % 2, 500.0, y0, y0 + 9, baseline, size, font, 612.0, 792.0, None, None)
    rows = [line(1, 1, i, 10.0 if i < 3 else 10.5, None if i < 3 else "Times", 60.0 + 12 * i, 70.0 + 12 * i if i != 2 else None) for i in range(5)]
    rows += [line(2, p, p, 9.5, "A", 90.0 + p, None) for p in (1, 2, 3)] + [line(None, 1, 1, 10.0, "B", 60.0, 1.0)]
    schema = "d long, page int, line_id long, native_id long, text string, x0 double, x1 double, y0 double, y1 double, baseline double, size double, font string, width double, height double, body_end int, references_at int"
    lines = spark.createDataFrame(rows, schema)
    body = {r["d"]: r for r in body_geometry(lines, ["d"]).collect()}
    assert body[1].asDict() == {"d": 1, "lines": 5, "pages": 1, "left": 72.0, "right": 500.0, "width": 428.0, "top": 60.0, "size": 10.0, "font": None, "line_gap": 12.0}
    assert body[2].asDict() == {"d": 2, "lines": 3, "pages": 3, "left": 73.0, "right": 500.0, "width": 427.0, "top": 91.5, "size": 9.5, "font": "A", "line_gap": None}
    assert (body[None]["lines"], body[None]["left"], body[None]["font"]) == (1, None, None)
    columns = {r["d"]: r for r in column_geometry(lines.withColumn("y0", F.col("y0") + 0.0), ["d"]).collect()}
    assert {d: (r["columns"], r["body_size"], r["lines"], r["pages"]) for d, r in columns.items()} == {1: (1, 10.0, 5, 1), 2: (1, 9.5, 3, 3)}
