"""Similarities count all characters of long texts, beyond the first 4,000 too."""

from __future__ import annotations

import difflib
import random

from pyspark.sql import functions as F

import quirework.queries  # noqa: F401
from quirework.operators.fusion import fuse_blocks
from quirework.registry import QUERIES


def letters(seed: int, n: int) -> str:
    """Of so many that none is frequent: runs begin at any."""
    return "".join(map(chr, random.Random(seed).choices(range(0x4E00, 0x4E00 + 400), k=n)))


def test_lines_alike_beyond_the_first_4000(spark, tmp_path):  # noqa: ANN001, ANN201
    one, two = letters(1, 4000) + letters(3, 5000), letters(2, 4000) + letters(3, 5000) + "end"
    spark.createDataFrame([(1, f"{one}\n{two}", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [r["similarity"] for r in QUERIES["X14_text_similarity"](spark, str(tmp_path)).collect()]
    assert found == [round(difflib.SequenceMatcher(None, two, one).ratio(), 6)] and found[0] > 0.5


def test_blocks_are_recovered_by_whole_texts(spark):  # noqa: ANN001, ANN201
    """Alike in the first 4,000 characters and not beyond: no native block; the other way round: one."""
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    natives = {1: letters(1, 4000) + letters(2, 9000), 2: letters(3, 4000) + letters(4, 9000)}
    asked = {1: letters(1, 4000) + letters(5, 9000), 2: letters(6, 4000) + letters(4, 9000)}
    lines = spark.createDataFrame([(1, (k, k, t, (10.0, 20.0 * k, 90.0, 20.0 * k + 9), 20.0 * k + 8, [])) for k, t in natives.items()], f"page int, line struct<line_id:bigint,native_id:bigint,text:string,box:{box},baseline:double,spans:array<struct<font:string,size:double,bold:boolean,italic:boolean,chars:bigint>>>")
    blocks = spark.createDataFrame([(1, k, "paragraph", t, None) for k, t in asked.items()], f"page int, block_id bigint, role string, text string, box {box}")
    pages = spark.createDataFrame([(1, 600.0, 800.0)], "page int, width double, height double")
    objects = spark.createDataFrame([], f"page int, object_id bigint, box {box}")
    found = {r["block_id"]: r for r in fuse_blocks(blocks, lines, objects, pages, ["page"]).collect()}
    want = {k: difflib.SequenceMatcher(None, asked[k], natives[k]).ratio() for k in asked}
    assert want[1] < 0.55 < want[2]
    assert found[1]["method"] == "none" and found[2]["method"] == "text_recovery" and found[2]["line_ids"] == [2]
    assert abs(found[2]["recovery_score"] - want[2]) < 1e-12


def test_keys_similarity_of_long_keys(spark):  # noqa: ANN001, ANN201
    from quirework.functions.udfs import keys_similarity

    a, b = letters(7, 4100) + "x" * 900, letters(7, 4100) + "y" * 900
    row = spark.createDataFrame([(a, b)], "a string, b string").select(keys_similarity(F.col("a"), F.col("b"))).first()
    assert row[0] == difflib.SequenceMatcher(None, a, b).ratio() < 1
