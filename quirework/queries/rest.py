"""Record shapes, repairs, inventories and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..operators import aggregates as A
from ..operators.relational import page_of
from ..operators.spatial import equal_boxes, touching
from ..registry import query, table
from .fixtures import BLOCKS, LINES, OBJECTS, blocks, box, lines, objects


@query("P02_caption_normalise", "SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_tax > 0.04 THEN 't' || l_partkey END, CASE WHEN l_discount > 0.04 THEN 'd' || l_suppkey END], lambda c: c IS NOT NULL), ' ') AS caption FROM lineitem")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_compact(F.array(F.when(F.col("l_tax") > 0.04, F.concat(F.lit("t"), "l_partkey")), F.when(F.col("l_discount") > 0.04, F.concat(F.lit("d"), "l_suppkey"))))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(keys, " ").alias("caption"))


@query("P04_metadata_chunk", "SELECT doc_id, 'source: ' || source || chr(10) || 'lang: ' || lang AS content, 0.2::DOUBLE AS weight FROM documents")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("source: "), "source", F.lit("\nlang: "), "lang").alias("content"), F.lit(0.2).alias("weight"))


@query("P06_reference_chunks", f"WITH {BLOCKS} SELECT doc_id, block_no, 0.35::DOUBLE AS weight FROM blocks WHERE regexp_matches(content, '[0-9]') UNION ALL SELECT doc_id, block_no, 1.0 FROM blocks WHERE NOT regexp_matches(content, '[0-9]')")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("content").rlike("[0-9]"), 0.35).otherwise(1.0)
    return blocks(spark, sf_dir).select("doc_id", "block_no", weight.alias("weight"))


@query("P09_record_converter", f"WITH {BLOCKS} SELECT doc_id AS paper_id, block_no AS position, page AS page_number, left(content, 80) AS quote, coalesce(nullif(source, 'src0'), 'Document') AS section_title FROM blocks")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.coalesce(F.nullif(F.col("source"), F.lit("src0")), F.lit("Document"))
    return blocks(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), F.col("block_no").alias("position"), F.col("page").alias("page_number"), F.left("content", F.lit(80)).alias("quote"), title.alias("section_title"))


@query("P12_facts_union", f"WITH {LINES}, {OBJECTS} SELECT page, line_id AS id, font AS style, 'line' AS kind FROM lines UNION ALL SELECT page, object_id, NULL, kind FROM objects")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lines(spark, sf_dir).select("page", F.col("line_id").alias("id"), F.col("font").alias("style"), F.lit("line").alias("kind"))
    return a.unionByName(objects(spark, sf_dir).select("page", F.col("object_id").alias("id"), "kind"), allowMissingColumns=True)


@query("P20_annotations", f"WITH {LINES} SELECT line_id, page, x0, y0 FROM lines WHERE x1 > x0 AND y1 > y0 AND page >= 1 AND chars > 48")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter(G.valid(box()) & (F.col("page") >= 1) & (F.col("chars") > 48)).select("line_id", "page", "x0", "y0")


@query("P22_compact_payload", "SELECT l_orderkey, array_to_string(list_slice(list(l_partkey ORDER BY l_linenumber, l_partkey), 1, 3), ',') AS parts FROM lineitem GROUP BY l_orderkey")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.slice(parts, 1, 3), lambda p: p["l_partkey"].cast("string")), ",").alias("parts"))


@query("P23_review_policy", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'manual' WHEN p_type LIKE '%STEEL%' THEN 'strict' ELSE 'default' END AS policy, p_size > 40 AS needs_reviewer FROM part")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = F.col("p_size") > 40
    return table(spark, sf_dir, "part").select("p_partkey", F.when(manual, "manual").when(F.col("p_type").contains("STEEL"), "strict").otherwise("default").alias("policy"), manual.alias("needs_reviewer"))


@query("S11_role_tagged_lines", f"""WITH {LINES}, s AS (SELECT page, median(font_size) AS body FROM lines GROUP BY page) SELECT line_id, CASE WHEN font_size >= body + 1.5 THEN 'heading' WHEN font_size <= body - 1.5 THEN 'note' ELSE 'body' END AS role FROM lines JOIN s USING (page)""")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines(spark, sf_dir)
    j = ls.join(ls.groupBy("page").agg(F.median("font_size").alias("body")), "page")
    return j.select("line_id", F.when(F.col("font_size") >= F.col("body") + 1.5, "heading").when(F.col("font_size") <= F.col("body") - 1.5, "note").otherwise("body").alias("role"))


@query("S16_rows_by_target", "SELECT p_brand AS target, count(*) AS rules FROM part GROUP BY p_brand")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("target")).agg(F.count("*").alias("rules"))


@query("J04_block_repair", f"WITH {BLOCKS}, r AS (SELECT doc_id, block_no, CASE WHEN block_no % 4 = 0 THEN 'x' || content END AS raw FROM blocks) SELECT b.doc_id, b.block_no, md5(coalesce(r.raw, b.content)) AS content_md5 FROM blocks b LEFT JOIN r ON b.doc_id = r.doc_id AND b.block_no = r.block_no")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    raw = b.filter("block_no % 4 = 0").select("doc_id", "block_no", F.concat(F.lit("x"), "content").alias("raw"))
    return b.join(raw, ["doc_id", "block_no"], "left").select("doc_id", "block_no", F.md5(F.coalesce("raw", "content")).alias("content_md5"))


@query("J09_span_to_block", f"""WITH {LINES}, {OBJECTS}, m AS (SELECT line_id, object_id, CASE WHEN l.x0 >= o.x0 AND l.x1 <= o.x1 THEN 4 ELSE 0 END + CASE WHEN l.y0 >= o.y0 AND l.y1 <= o.y1 THEN 2 ELSE 0 END + 1 AS score FROM lines l JOIN objects o ON l.page = o.page WHERE greatest(0.0, least(l.x1, o.x1) - greatest(l.x0, o.x0)) * greatest(0.0, least(l.y1, o.y1) - greatest(l.y0, o.y0)) > 0)
 SELECT line_id, object_id, score FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, object_id) AS n FROM m) WHERE n = 1""")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines(spark, sf_dir).select("page", "line_id", box().alias("l"))
    ob = equal_boxes(objects(spark, sf_dir).select("page", "object_id", box().alias("o")), ["page"], "o", F.min("object_id").alias("object_id"))
    across = (F.col("l.x0") >= F.col("o.x0")) & (F.col("l.x1") <= F.col("o.x1"))
    down = (F.col("l.y0") >= F.col("o.y0")) & (F.col("l.y1") <= F.col("o.y1"))
    found = touching(ls, ob, ["page"], "l", "o").filter(G.overlap(F.col("l"), F.col("o")) > 0).withColumn("score", F.when(across, 4).otherwise(0) + F.when(down, 2).otherwise(0) + 1)
    best = F.min_by(F.struct("object_id", "score"), F.struct(-F.col("score"), F.col("object_id")))
    return found.groupBy("line_id").agg(best.alias("b")).select("line_id", "b.object_id", "b.score")


@query("A16_body_geometry", f"WITH {LINES}, p AS (SELECT page, min(y0) AS top, max(y1) AS bottom FROM lines GROUP BY page) SELECT median(top) AS top, median(bottom) AS bottom, count(*) AS pages FROM p")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = lines(spark, sf_dir).groupBy("page").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    return per.agg(F.median("top").alias("top"), F.median("bottom").alias("bottom"), F.count("*").alias("pages"))


@query("A22_letter_continuity", "SELECT s_nationkey, count(DISTINCT s_suppkey % 7) AS letters, max(s_suppkey % 7) + 1 = count(DISTINCT s_suppkey % 7) AS continuous FROM supplier GROUP BY s_nationkey")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_set(F.col("s_suppkey") % 7)).alias("letters"))
    return got.select("s_nationkey", F.size("letters").cast("long").alias("letters"), (F.col("letters") == F.sequence(F.lit(0).cast("long"), F.array_max("letters"))).alias("continuous"))


@query("A25_front_matter", f"WITH {BLOCKS} SELECT doc_id, max(CASE WHEN block_no = 0 THEN length(content) END) AS title_chars, count(*) FILTER (WHERE block_no < 3) AS front_blocks FROM blocks GROUP BY doc_id")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).groupBy("doc_id").agg(F.max(F.when(F.col("block_no") == 0, F.length("content"))).cast("long").alias("title_chars"), F.count_if(F.col("block_no") < 3).alias("front_blocks"))


@query("A26_abstract", f"WITH {BLOCKS}, n AS (SELECT doc_id, block_no, content, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS i FROM blocks) SELECT doc_id, len(regexp_extract_all(content, '[.!?](\\s|$)')) AS sentences FROM n WHERE i = 2")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = blocks(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))).filter("i = 2")
    return second.select("doc_id", F.regexp_count("content", F.lit(r"[.!?](\s|$)")).cast("long").alias("sentences"))


@query("A35_object_facts", f"WITH {LINES}, {OBJECTS}, f AS (SELECT page, font, sum(chars) AS w FROM lines GROUP BY 1, 2), d AS (SELECT page, font FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w DESC, font) AS n FROM f) WHERE n = 1), o AS (SELECT page, count(*) FILTER (WHERE kind = 'table') AS tables, count(*) FILTER (WHERE kind = 'figure') AS figures FROM objects GROUP BY page) SELECT page, font, tables, figures FROM d JOIN o USING (page)")
def a35(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir).groupBy("page").agg(F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "figure").alias("figures"))
    return A.dominant(lines(spark, sf_dir), ["page"], "font", "chars").drop("weight").join(o, "page")


@query("X10_cells_to_matrix", "SELECT l_orderkey, string_agg(cells, chr(10) ORDER BY r) AS matrix FROM (SELECT l_orderkey, l_linenumber % 2 AS r, string_agg(l_partkey, '|' ORDER BY l_linenumber, l_partkey) AS cells FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("r")).agg(F.array_join(F.transform(cells, lambda c: c["l_partkey"].cast("string")), "|").alias("cells"))
    both = F.array_sort(F.collect_list(F.struct("r", "cells")))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(both, lambda p: p["cells"]), "\n").alias("matrix"))


@query("X20_content_preferences", "SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(lower(text), 'table') THEN 'table' END, CASE WHEN contains(lower(text), 'figure') THEN 'figure' END, CASE WHEN contains(lower(text), 'code') THEN 'algorithm' END) AS preferences FROM conversations")
def x20(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(",", F.when(low.contains("table"), "table"), F.when(low.contains("figure"), "figure"), F.when(low.contains("code"), "algorithm")).alias("preferences"))


@query("X33_observation_strings", "SELECT l_orderkey, l_linenumber, printf('%d of %d at %.2f', l_linenumber, l_suppkey, l_extendedprice) AS observation FROM lineitem")
def x33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%d of %d at %.2f", "l_linenumber", "l_suppkey", "l_extendedprice").alias("observation"))


@query("R08_budget_refinement", f"""WITH RECURSIVE {BLOCKS}, u AS (SELECT doc_id, min(block_no) AS lo, max(block_no) AS hi, CAST(sum(length(content)) AS BIGINT) AS size, 0 AS depth FROM blocks GROUP BY doc_id),
 s AS (SELECT doc_id, lo, hi, size, depth FROM u UNION ALL SELECT s.doc_id, CASE WHEN h = 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN h = 0 THEN (lo + hi) // 2 ELSE hi END, (SELECT CAST(coalesce(sum(length(content)), 0) AS BIGINT) FROM blocks b WHERE b.doc_id = s.doc_id AND b.block_no BETWEEN CASE WHEN h = 0 THEN lo ELSE (lo + hi) // 2 + 1 END AND CASE WHEN h = 0 THEN (lo + hi) // 2 ELSE hi END), depth + 1 FROM s, (SELECT unnest([0, 1]) AS h) WHERE size > 3000 AND hi > lo AND depth < 8)
 SELECT doc_id, lo, hi, size FROM s WHERE NOT (size > 3000 AND hi > lo AND depth < 8)""")
def r08(spark: SparkSession, sf_dir: str, budget: int = 3000, depth: int = 8) -> DataFrame:
    """Halves block ranges over budget, at most ``depth`` times; sizes are differences of running sums."""
    b = blocks(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = b.select("doc_id", "block_no", F.sum(F.length("content")).over(w).cast("long").alias("run"))
    units = b.groupBy("doc_id").agg(F.min("block_no").alias("lo"), F.max("block_no").alias("hi"))
    marks = sums.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "run"))).alias("marks"))
    upto = lambda m, n: F.coalesce(F.array_max(F.transform(F.filter(m, lambda x: x["block_no"] <= n), lambda x: x["run"])), F.lit(0))
    unit = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    ranges = F.array(unit(F.col("lo"), F.col("hi")))
    size = lambda u: upto(F.col("marks"), u["hi"]) - upto(F.col("marks"), u["lo"] - 1)
    now = units.join(marks, "doc_id").withColumn("units", ranges)
    for _ in range(depth):
        half = lambda u: F.floor((u["lo"] + u["hi"]) / 2).cast("int")
        now = now.withColumn("units", F.flatten(F.transform("units", lambda u: F.when((size(u) > budget) & (u["hi"] > u["lo"]), F.array(unit(u["lo"], half(u)), unit(half(u) + 1, u["hi"]))).otherwise(F.array(unit(u["lo"], u["hi"]))))))
    return now.select("doc_id", "marks", F.explode("units").alias("u")).select("doc_id", "u.lo", "u.hi", size(F.col("u")).alias("size"))


@query("R18_supplemental_evidence", f"WITH {LINES} SELECT page, 'overflow' AS category, count(*) AS n FROM lines WHERE x1 > 540 GROUP BY page UNION ALL SELECT page, 'small', count(*) FROM lines WHERE font_size < 9 GROUP BY page")
def r18(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines(spark, sf_dir)
    return ls.filter("x1 > 540").groupBy("page", F.lit("overflow").alias("category")).agg(F.count("*").alias("n")).union(ls.filter("font_size < 9").groupBy("page", F.lit("small").alias("category")).agg(F.count("*").alias("n")))


@query("R22_recovered_references", rf"WITH {BLOCKS} SELECT doc_id, count(*) AS refs FROM blocks WHERE regexp_matches(content, '^\[\d+\]|^[A-Z][a-z]+,') GROUP BY doc_id")
def r22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).filter(F.col("content").rlike(r"^\[\d+\]|^[A-Z][a-z]+,")).groupBy("doc_id").agg(F.count("*").alias("refs"))


@query("T06_list_slice", "SELECT event_id FROM events ORDER BY event_id LIMIT 25 OFFSET 50")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_of(table(spark, sf_dir, "events").select("event_id"), [F.asc("event_id")], 3, 25)


@query("K09_golden_report", "SELECT lang, count(*) || ' documents, ' || count(*) FILTER (WHERE n_chars > 1000) || ' long' AS line FROM documents GROUP BY lang")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("m"))
    return g.select("lang", F.concat("n", F.lit(" documents, "), "m", F.lit(" long")).alias("line"))


@query("K11_immutable_cache_fill", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).drop("event_type")

