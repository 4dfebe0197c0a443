"""Further projections, filters, planning and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import split, udfs
from ..functions import text as X
from ..operators.relational import first_wins, settled, top_per_group
from ..registry import query, table
from ..sources.sinks import report_lines
from .fixtures import BLOCKS, LINES, OBJECTS, blocks, lines, objects


@query("F05_native_graphic", f"WITH {OBJECTS} SELECT object_id, kind IN ('figure', 'drawing') AS graphic FROM objects")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).select("object_id", F.col("kind").isin("figure", "drawing").alias("graphic"))


@query("F07_rule_applicability", f"WITH {OBJECTS} SELECT p_partkey AS rule_id, count(object_id) AS evidence, count(object_id) > 0 AS applicable FROM part LEFT JOIN objects ON page = p_size AND kind = 'table' GROUP BY p_partkey")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = objects(spark, sf_dir).filter("kind = 'table'").groupBy("page").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part")
    n = F.coalesce("n", F.lit(0))
    return p.join(per, p.p_size == per.page, "left").select(F.col("p_partkey").alias("rule_id"), n.alias("evidence"), (n > 0).alias("applicable"))


@query("F08_derived_relevance", "SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN p_size > 10 WHEN 'Brand#22' THEN p_size > 20 ELSE false END AS relevant FROM part")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.when(F.col("p_brand") == "Brand#11", 10).when(F.col("p_brand") == "Brand#22", 20)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.col("p_size") > least, F.lit(False)).alias("relevant"))


@query("F10_inside_page", f"WITH {LINES} SELECT line_id FROM lines WHERE x0 >= -2 AND y0 >= -2 AND x1 <= 502 AND y1 <= 602")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter("x0 >= -2 and y0 >= -2 and x1 <= 502 and y1 <= 602").select("line_id")


@query("F14_column_candidates", f"WITH {LINES} SELECT line_id FROM lines WHERE (x1 - x0) / 612 BETWEEN 0.08 AND 0.48")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter(((F.col("x1") - F.col("x0")) / 612).between(0.08, 0.48)).select("line_id")


@query("F15_group_scoped_facts", f"WITH {BLOCKS} SELECT doc_id, block_no FROM blocks WHERE source IN (SELECT DISTINCT 'src' || p_size FROM part WHERE p_size < 6)")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "part").filter("p_size < 6").select(F.concat(F.lit("src"), "p_size").alias("source")).distinct()
    return blocks(spark, sf_dir).join(groups, "source", "left_semi").select("doc_id", "block_no")


_LADDER = " ".join(f"WHEN {' OR '.join(f"contains(lower(content), '{word}')" for word in words)} THEN '{role}'" for role, words in X.SECTION_ROLES)


@query("F19_first_match", f"WITH {BLOCKS} SELECT doc_id, block_no, CASE {_LADDER} ELSE 'body' END AS role FROM blocks")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "block_no", X.classify_section(F.array("content")).alias("role"))


@query("P01_section_path", f"""WITH {BLOCKS}, h AS (SELECT doc_id, block_no, content, CASE WHEN block_no % 9 = 0 THEN 1 WHEN block_no % 3 = 0 THEN 2 END AS level FROM blocks), a AS (SELECT *, last_value(CASE WHEN level = 1 THEN block_no END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 2 THEN block_no END IGNORE NULLS) OVER w AS h2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING))
 SELECT doc_id, block_no, concat_ws(' > ', h1, CASE WHEN h2 > coalesce(h1, -1) THEN h2 END) AS section FROM a""")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading holds until one of its level or above follows."""
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("block_no") % 9 == 0, 1).when(F.col("block_no") % 3 == 0, 2)
    last = lambda n: F.last(F.when(level == n, F.col("block_no")), ignorenulls=True).over(w)
    b = blocks(spark, sf_dir).withColumn("h1", last(1)).withColumn("h2", last(2))
    return b.select("doc_id", "block_no", F.concat_ws(" > ", F.col("h1").cast("string"), F.when(F.col("h2") > F.coalesce("h1", F.lit(-1)), F.col("h2")).cast("string")).alias("section"))


@query("P07_table_row_groups", "SELECT l_orderkey AS o_orderkey, g * 4 + 2 AS first_row, least(4, n - (g * 4 + 2)) AS rows FROM (SELECT l_orderkey, n, unnest(range(0, (n - 2 + 3) // 4)) AS g FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 2)")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups of four after two header rows."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")).filter("n > 2")
    groups = n.select("o_orderkey", "n", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n") - 1, F.lit(4).cast("long"))).alias("first_row"))
    return groups.select("o_orderkey", "first_row", F.least(F.lit(4), F.col("n") - F.col("first_row")).cast("long").alias("rows"))


@query("P08_source_priority", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.06 THEN 'specialised' END, CASE WHEN l_discount > 0.06 THEN 'parser' END, 'fallback') AS source FROM lineitem")
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.coalesce(F.when(F.col("l_tax") > 0.06, "specialised"), F.when(F.col("l_discount") > 0.06, "parser"), F.lit("fallback"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pick.alias("source"))


@query("P11_review_facts", f"WITH {LINES}, {OBJECTS}, f AS (SELECT page, y0, line_id AS id, 'line' AS source FROM lines UNION ALL SELECT page, y0, object_id, 'object' FROM objects) SELECT source, id, 'P' || row_number() OVER (PARTITION BY page ORDER BY y0, source, id) AS evidence_id, page FROM f")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lines(spark, sf_dir).select("page", "y0", F.col("line_id").alias("id"), F.lit("line").alias("source"))
    f = a.unionByName(objects(spark, sf_dir).select("page", "y0", F.col("object_id").alias("id"), F.lit("object").alias("source")))
    return f.select("source", "id", F.concat(F.lit("P"), F.row_number().over(Window.partitionBy("page").orderBy("y0", "source", "id"))).alias("evidence_id"), "page")


@query("P16_mode_routing", "SELECT p_partkey, CASE WHEN p_size < 20 THEN 'short' ELSE 'long' END AS mode FROM part WHERE p_brand <> 'Brand#11' UNION ALL SELECT -1, 'shared'")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "part").filter("p_brand <> 'Brand#11'").select("p_partkey", F.when(F.col("p_size") < 20, "short").otherwise("long").alias("mode"))
    return out.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit("shared").alias("mode")))


@query("P18_keyword_lists", "SELECT p_partkey, array_to_string(list_distinct(string_split(lower(p_name), ' ')), ' ') IS NOT NULL AS has_words, len(list_distinct(string_split(lower(p_name || ' ' || p_brand), ' '))) AS words FROM part")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand")), " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").isNotNull().alias("has_words"), F.size(words).cast("long").alias("words"))


@query("P21_item_record", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey % 10))), ',') AS pages, arg_min(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS first_annotation FROM lineitem GROUP BY l_orderkey")
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey") % 10)).cast("array<string>"), ",").alias("pages"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_annotation"))


@query("X05_split_at_token_limit")
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.normalize_prose(F.col("text")).alias("text"))
    return d.select("doc_id", F.posexplode(split.splitter(120)("text")).alias("piece", "text"))


@query("X08_html_table")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.split("content", r" \| ")
    html = F.concat(F.lit("<table><tr><td rowspan=2>k</td><td>"), F.array_join(cells, "</td><td>"), F.lit("</td></tr><tr><td colspan=2>x</td></tr></table>"))
    return blocks(spark, sf_dir).filter(F.col("content").contains(" | ")).select("doc_id", "block_no", F.to_json(udfs.html_table(html)).alias("matrix"))


@query("X14_text_similarity")
def x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("block_no")
    b = blocks(spark, sf_dir).withColumn("before", F.lag("content").over(w)).filter("before is not null")
    keyed = settled(b, _x=X.letters_key(F.col("content")), _y=X.letters_key(F.col("before")))
    return keyed.select("doc_id", "block_no", F.round(udfs.keys_similarity(F.col("_x"), F.col("_y")), 6).alias("similarity"))


@query("X12_redaction", """SELECT event_id, regexp_replace(props, '"ref":\\s*"[^"]*"', '"ref":"***"', 'g') AS props FROM events""")
def x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.regexp_replace("props", r'"ref":\s*"[^"]*"', '"ref":"***"').alias("props"))


@query("X26_name_sanitise", r"SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug, TRY_CAST(regexp_extract(p_name, '\d+') AS BIGINT) AS number FROM part")
def x26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-").alias("slug"), F.regexp_extract("p_name", r"\d+", 0).try_cast("long").alias("number"))


@query("X31_category_query", "SELECT p_brand, string_agg(p_type, ' ' ORDER BY p_type) AS query FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand")
def x31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), " ").alias("query"))


@query("X32_line_join", f"WITH {LINES}, g AS (SELECT page, line_id, x0, y0, CASE WHEN x0 - lag(x1) OVER w >= 1 THEN 1 ELSE 0 END AS space FROM lines WINDOW w AS (PARTITION BY page ORDER BY y0, x0, line_id)) SELECT page, md5(string_agg(CASE WHEN space = 1 THEN ' ' ELSE '' END || line_id, '' ORDER BY y0, x0, line_id)) AS joined FROM g GROUP BY page")
def x32(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page").orderBy("y0", "x0", "line_id")
    g = lines(spark, sf_dir).withColumn("t", F.concat(F.when(F.col("x0") - F.lag("x1").over(w) >= 1, " ").otherwise(""), F.col("line_id").cast("string")))
    parts = F.array_sort(F.collect_list(F.struct("y0", "x0", "line_id", "t")))
    return g.groupBy("page").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["t"]), "")).alias("joined"))


@query("W05_visual_lines", f"WITH {LINES}, g AS (SELECT page, line_id, y0, CASE WHEN y0 - lag(y0) OVER w <= 1 THEN 0 ELSE 1 END AS fresh FROM lines WINDOW w AS (PARTITION BY page ORDER BY y0, line_id)) SELECT page, line_id, CAST(sum(fresh) OVER (PARTITION BY page ORDER BY y0, line_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visual_line FROM g")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers lines whose tops follow within 1.0 of the one before: a chain of neighbours. Tops are whole numbers
    here. W05_anchored_lines compares with a line's first fragment instead."""
    w = Window.partitionBy("page").orderBy("y0", "line_id")
    fresh = F.when(F.col("y0") - F.lag("y0").over(w) <= 1, 0).otherwise(1)
    return lines(spark, sf_dir).withColumn("fresh", fresh).select("page", "line_id", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("visual_line"))


@query("W08_section_sampling", f"""WITH {BLOCKS}, n AS (SELECT source, count(*) AS len FROM blocks GROUP BY source), slots AS (SELECT source, len, unnest(range(1, len + 1)) AS k FROM n), q AS (SELECT source, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, CAST(len AS DOUBLE) / greatest(k - 1, 1) DESC, source, k) AS r FROM slots) WHERE r <= 120 GROUP BY source)
 SELECT source, quota FROM q""")
def w08(spark: SparkSession, sf_dir: str, most: int = 120) -> DataFrame:
    """Slots by section: one each, the rest to the largest len / quota, by ranking len / k over all k."""
    n = blocks(spark, sf_dir).groupBy("source").agg(F.count("*").alias("len"))
    slots = n.select("source", "len", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("len"), F.lit(most)))).alias("k"))
    picked = slots.orderBy(F.when(F.col("k") == 1, 0).otherwise(1), F.desc(F.col("len").cast("double") / F.greatest(F.col("k") - 1, F.lit(1))), "source", "k").limit(most)
    return picked.groupBy("source").agg(F.count("*").alias("quota"))


@query("W12_cross_category_union", f"WITH {BLOCKS}, u AS (SELECT doc_id, block_no, 0 AS c FROM blocks WHERE contains(content, '|') UNION ALL SELECT doc_id, block_no, 1 FROM blocks WHERE length(content) < 80), d AS (SELECT doc_id, block_no, min(c) AS c FROM u GROUP BY 1, 2) SELECT doc_id, block_no, c FROM d ORDER BY c, doc_id, block_no LIMIT 48")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    u = b.filter(F.col("content").contains("|")).select("doc_id", "block_no", F.lit(0).alias("c")).union(b.filter(F.length("content") < 80).select("doc_id", "block_no", F.lit(1)))
    return first_wins(u, ["doc_id", "block_no"], [F.asc("c")]).orderBy("c", "doc_id", "block_no").limit(48)


@query("A21_reference_inventory", "WITH g AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) SELECT o_custkey, count(*) AS entries, count(*) FILTER (WHERE before > o_orderstatus) AS violations FROM g GROUP BY o_custkey")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("before", before).groupBy("o_custkey").agg(F.count("*").alias("entries"), F.count_if(F.col("before") > F.col("o_orderstatus")).alias("violations"))


@query("A34_baseline_samples", f"WITH {LINES}, g AS (SELECT page, round_even(x0 / 10, 0) AS origin, lead(y1) OVER (PARTITION BY page, round_even(x0 / 10, 0) ORDER BY y1, line_id) - y1 AS gap FROM lines) SELECT page, origin, gap FROM g WHERE gap BETWEEN 8 AND 20")
def a34(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.bround(F.col("x0") / 10)
    gap = F.lead("y1").over(Window.partitionBy("page", origin).orderBy("y1", "line_id")) - F.col("y1")
    return lines(spark, sf_dir).select("page", origin.alias("origin"), gap.alias("gap")).filter("gap between 8 and 20")


@query("T01_topk", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 24")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(24).select("doc_id", "n_chars")


@query("T09_ordered_children", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS position FROM lineitem")
def t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")).alias("position"))


@query("R12_downgrade", "SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_tax > 0.04) AS actionable, count(*) FILTER (WHERE l_returnflag <> 'N') AS frozen FROM lineitem GROUP BY l_orderkey")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.04)).alias("actionable"), F.count_if(F.col("l_returnflag") != "N").alias("frozen"))


@query("R21_bounded_understanding", f"WITH {BLOCKS}, r AS (SELECT source, doc_id, block_no, left(content, 2000) AS quote, row_number() OVER (PARTITION BY source ORDER BY length(content) DESC, doc_id, block_no) AS rank FROM blocks) SELECT source, doc_id, block_no, md5(quote) AS quote_md5 FROM r WHERE rank <= 24")
def r21(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = top_per_group(blocks(spark, sf_dir), ["source"], [F.desc(F.length("content")), F.asc("doc_id"), F.asc("block_no")], 24)
    return b.select("source", "doc_id", "block_no", F.md5(F.left("content", F.lit(2000))).alias("quote_md5"))


@query("K08_report_markdown", f"WITH {BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS n FROM blocks) SELECT doc_id, md5('# ' || doc_id || chr(10) || string_agg('- [E' || n || '] ' || content, chr(10) ORDER BY n)) AS report FROM r WHERE n <= 6 GROUP BY doc_id")
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_lines(blocks(spark, sf_dir), "doc_id", "block_no", "content").select("doc_id", F.md5("markdown").alias("report"))
