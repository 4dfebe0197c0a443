"""Pages as rows give what joins of their parts give, and their texts are exchanged once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import quirework.queries  # noqa: F401
from quirework.operators.fusion import fuse_blocks, fuse_pages
from quirework.operators.sequences import holding_runs, page_holding_runs, page_similar_runs, similar_runs
from quirework.operators.spans import matching_spans, page_matching_spans
from quirework.registry import QUERIES


@pytest.mark.parametrize("name", ["J10_holding_line_runs", "J10_similar_line_runs", "J09_matching_spans", "J07_block_fusion"])
def test_texts_travel_once(spark, name):  # noqa: ANN001, ANN201
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.splitlines() if "Exchange" in x]
    assert "Exchange hashpartitioning(doc_id" in wide[-1] and len(wide) <= 2
    assert "BroadcastExchange" not in plan and "SortMergeJoin" not in plan


def pages(rng: random.Random) -> tuple[list, list]:
    text = lambda most: "".join(rng.choices("ab", k=rng.choice([0, 2, 5, 9, 14, most])))
    lines = [(p, i, text(20)) for p in range(12) for i in range(rng.choice([0, 1, 9, 30]))]
    blocks = []
    for p in range(12):
        own = [x[2] for x in lines if x[0] == p]
        for k in range(8):
            at = rng.randrange(len(own)) if own else 0
            joined = "".join(own[at : at + rng.randint(1, 7)])
            blocks.append((p, k, rng.choice([joined, joined[:-1] + "c", "x" + joined, text(40)])))
    return blocks, lines


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_pages(spark, seed):  # noqa: ANN001, ANN201
    blocks, lines = pages(random.Random(seed))
    bs, ls = spark.createDataFrame(blocks, "page int, block_id int, key string"), spark.createDataFrame(lines, "page int, at int, key string")
    rows = bs.groupBy("page").agg(F.collect_list(F.struct("block_id", "key")).alias("blocks")).join(ls.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("lines")), "page")
    for one, other in ((holding_runs, page_holding_runs), (similar_runs, page_similar_runs)):
        columns = ["page", "block_id", "first_line", "lines", "score"]
        want, got = (sorted(tuple(r) for r in df.select(columns).collect()) for df in (one(bs, ls, ["page"]), other(rows, ["page"])))
        assert got == want and len(want) > 20


def test_spans_of_pages(spark):  # noqa: ANN001, ANN201
    rng = random.Random(3)
    words = lambda: rng.choice([" ", "-"]).join(rng.choices(["abc", "abcd", "xyz", "Long er", "q"], k=rng.randint(0, 6)))
    box = lambda: None if rng.random() < 0.2 else (x := float(rng.randint(0, 2)), 0.0, x + rng.choice([9.0, 10.0, 0.0]), 10.0)
    schema = "page int, {0} int, text string, box struct<x0:double,y0:double,x1:double,y1:double>"
    bs, ss = (spark.createDataFrame([(p, i, rng.choice([words(), words(), None]), box()) for p in range(5) for i in range(12)], schema.format(own)) for own in ("block_id", "span_id"))
    gather = lambda df, own, name: df.groupBy("page").agg(F.collect_list(F.struct(own, "text", "box")).alias(name))
    rows = gather(bs, "block_id", "blocks").join(gather(ss, "span_id", "spans"), "page")
    want, got = (sorted(tuple(r) for r in df.select("page", "block_id", "span_id", "score", "rank").collect()) for df in (matching_spans(bs, ss, ["page"]), page_matching_spans(rows, ["page"])))
    assert got == want and len({r[3] for r in want}) > 5


def test_fusion_of_pages(spark):  # noqa: ANN001, ANN201
    """Boxes that miss, conflict or are none, texts that are null, empty, alike and equal, and objects."""
    rng = random.Random(5)
    shape = "struct<x0:double,y0:double,x1:double,y1:double>"
    line = f"struct<line_id:bigint,native_id:bigint,text:string,box:{shape},baseline:double,spans:array<struct<font:string,size:double,bold:boolean,italic:boolean,chars:bigint>>>"
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 9)))
    lines, blocks, objects = [], [], []
    for p in range(8):
        own = {}
        for i in range(rng.choice([1, 6, 14])):
            box = (10.0, 20.0 * i, 200.0 + rng.randint(0, 9), 20.0 * i + 10)
            text = rng.choice([" ".join(word() for _ in range(6)), "Straße ﬁn"])
            lines.append((p, (i, i // 2, text, box, box[3] - 2, [("F", rng.choice([9.0, 10.0]), False, i % 2 == 0, len(text))])))
            own.setdefault(i // 2, []).append((text, box))
        for k, parts in own.items():
            text, box = " ".join(x[0] for x in parts), (10.0, parts[0][1][1], 205.0, parts[-1][1][3])
            away = (10.0, rng.choice([0.0, 60.0, 500.0, 2000.0]), 205.0, 90.0 + rng.choice([0.0, 500.0, 2000.0]))
            near = text[: len(text) // 2] + rng.choice(["", "zz", "zzzz zzz"]) + text[len(text) // 2 + 2 :]
            blocks.append((p, k, rng.choice(["paragraph", "table_object", "figure_object"]), rng.choice([text, near, near, near[::-1], "", None]), rng.choice([box, away, None])))
            if rng.random() < 0.5:
                objects.append((p, k, rng.choice([box, away])))
    ls, bs = spark.createDataFrame(lines, f"page int, line {line}"), spark.createDataFrame(blocks, f"page int, block_id bigint, role string, text string, box {shape}")
    os = spark.createDataFrame(objects, f"page int, object_id bigint, box {shape}")
    sizes = ls.select("page").distinct().select("page", F.lit(300.0).alias("width"), F.lit(700.0).alias("height"))
    natives = ls.groupBy("page", "line.native_id").agg(F.array_sort(F.collect_list("line")).alias("lines")).groupBy("page").agg(F.collect_list(F.struct("native_id", "lines")).alias("natives"))
    rows = bs.groupBy("page").agg(F.collect_list(F.struct("block_id", "role", "text", "box")).alias("blocks")).join(natives, "page").join(sizes, "page")
    rows = rows.join(os.groupBy("page").agg(F.collect_list(F.struct("object_id", "box")).alias("objects")), "page", "left").withColumn("objects", F.coalesce("objects", F.array().cast(f"array<struct<object_id:bigint,box:{shape}>>")))
    rows = rows.withColumn("lines", F.flatten(F.transform("natives", lambda x: x["lines"])))

    def told(df):  # noqa: ANN001, ANN202
        numbers = ["iou", "spatial_score", "place_text_score", "recovery_score", "text_score", "confidence"]
        return sorted(str(tuple(r)) for r in df.select("page", "block_id", "text", "box", "box_source", *(F.round(c, 9) for c in numbers), "method", "status", "box_status", "inside", "reasons", "line_ids", "style").collect())

    one, other = fuse_blocks(bs, ls, os, sizes, ["page"]), fuse_pages(rows, ["page"])
    want, got = told(one), told(other)
    assert got == want and len(want) == len(blocks)
    assert {r["method"] for r in one.select("method").distinct().collect()} == {"native_object", "text_recovery", "box_cross_checked", "none"}
