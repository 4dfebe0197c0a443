"""What travels to the cells of a page is no wider than what the join looks at."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.operators import fusion
from quirework.operators.order import visual_lines

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
LINE = f"struct<line_id:bigint,native_id:bigint,text:string,box:{BOX},baseline:double,spans:array<struct<font:string,size:double,bold:boolean,italic:boolean,chars:bigint>>>"


def test_lines_meet_blocks_without_their_texts(spark, monkeypatch):  # noqa: ANN001, ANN201
    """Wide lines go to one or two cells; those without an id or with an equal one all count."""
    seen = {}

    def spied(left, *args, **kwargs):  # noqa: ANN001, ANN002, ANN003, ANN202
        seen["columns"] = left.columns
        return touching(left, *args, **kwargs)

    touching = fusion.touching
    monkeypatch.setattr(fusion, "touching", spied)
    rows = [(1, (n, 1, f"t{i}", (72.0, y, 522.0, y + 10), y + 8, [])) for i, (n, y) in enumerate([(1, 40.0), (None, 54.0), (3, 68.0), (3, 68.0), (5, 400.0)])]
    blocks = spark.createDataFrame([(1, 9, (72.0, 40.0, 522.0, 80.0), True)], f"page int, block_id int, box {BOX}, inside boolean")
    found = fusion._lines_in(blocks, spark.createDataFrame(rows, f"page int, line {LINE}"), ["page"]).select("block_id", F.col("spatial.text").alias("text"), "spatial.n").collect()
    assert [(r["block_id"], r["n"], r["text"][:5]) for r in found] == [(9, 4, "t0 t1")]
    assert "line" not in seen["columns"]


def test_fragments_are_dealt_anew(spark):  # noqa: ANN001, ANN201
    """Fragments cut from few rows are sorted in tasks sized by the fragments, not by those rows."""
    lines = spark.range(40).repartition(2, "id").select("id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("f"))
    box = F.struct(*(F.col("f").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    given = lines.select("id", (F.col("f") % 2).alias("page"), F.lit("t").alias("text"), box.alias("box"), (F.col("f") * 0.6).alias("baseline"))
    found = visual_lines(given, ["id", "page"])
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()
    assert found.agg(F.sum("fragments")).first()[0] == 240
