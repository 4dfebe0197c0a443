"""Aggregation, metric and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..registry import query, table
from .fixtures import BLOCKS, LINES, blocks, lines


@query("A01_count", "SELECT count(*) AS n FROM documents WHERE n_chars > 100")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("n_chars > 100").agg(F.count("*").alias("n"))


@query("A02_group_count", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("A03_quality_report", """SELECT source, count(*) AS documents, count(*) FILTER (WHERE n_chars < 200) AS short, count(*) FILTER (WHERE contains(text, '??')) AS odd,
 CASE WHEN count(*) FILTER (WHERE contains(text, '??')) > 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE n_chars < 200) > 0 THEN 'PARTIAL' ELSE 'READY' END AS status FROM documents GROUP BY source""")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_if(F.col("text").contains("??")).alias("odd"))
    return g.withColumn("status", F.when(F.col("odd") > 0, "FAILED").when(F.col("short") > 0, "PARTIAL").otherwise("READY"))


@query("A04_flag_counts", rf"""WITH {BLOCKS} SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN contains(content, '|') THEN 'table' END, CASE WHEN regexp_matches(content, '[0-9]') THEN 'digits' END, CASE WHEN contains(content, '@') THEN 'mail' END]) AS flag FROM blocks) WHERE flag IS NOT NULL GROUP BY flag""")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    flags = F.array_compact(F.array(F.when(c.contains("|"), "table"), F.when(c.rlike("[0-9]"), "digits"), F.when(c.contains("@"), "mail")))
    return blocks(spark, sf_dir).select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("A05_metrics_overview", """WITH t AS (SELECT event_type, CAST(floor(abs(value) * 1000) AS BIGINT) AS ms FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ms) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM t)
 SELECT event_type, count(*) AS requests, max(CASE WHEN i = greatest(1, least(n, floor(n * 0.5 + 0.9999))) THEN ms END) AS p50, max(CASE WHEN i = greatest(1, least(n, floor(n * 0.95 + 0.9999))) THEN ms END) AS p95 FROM r GROUP BY event_type""")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_type", F.floor(F.abs("value") * 1000).alias("ms"))
    return t.groupBy("event_type").agg(F.count("*").alias("requests")).join(A.ranked_percentiles(t, ["event_type"], "ms", {"p50": 0.5, "p95": 0.95}), "event_type")


@query("A06_linear_percentile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY l_returnflag")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.linear_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p90": 0.9})
    return found.select("l_returnflag", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


@query("A07_median", "SELECT lang, median(n_chars) AS median_chars FROM documents GROUP BY lang")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.median("n_chars").alias("median_chars"))


@query("A08_weighted_median", f"""WITH {LINES}, w AS (SELECT page, font_size, sum(greatest(chars, 1)) AS w FROM lines GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY page ORDER BY font_size ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY page) AS whole FROM w)
 SELECT page, min(font_size) AS weighted_median FROM r WHERE run * 2 >= whole GROUP BY page""")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.weighted_median(lines(spark, sf_dir), ["page"], "font_size", "chars")


@query("A09_binned_mode", f"""WITH {LINES}, b AS (SELECT page, round_even(x0 / 2.0, 0) AS bin, count(*) AS n, round(stddev_pop(x0), 9) AS sd, median(x0) AS m FROM lines GROUP BY 1, 2)
 SELECT page, m AS binned_mode, n AS members FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, sd, bin) AS r FROM b) WHERE r = 1""")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.binned_mode(lines(spark, sf_dir), ["page"], "x0", 2.0)


@query("A10_rounded_mode", f"WITH {LINES}, b AS (SELECT page, round_even(font_size, 1) AS mode, count(*) AS n FROM lines GROUP BY 1, 2) SELECT page, mode FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, mode) AS r FROM b) WHERE r = 1")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded_mode(lines(spark, sf_dir), ["page"], "font_size")


@query("A11_dominant_font", f"WITH {LINES}, b AS (SELECT page, font, sum(chars) AS weight FROM lines GROUP BY 1, 2) SELECT page, font, weight FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY weight DESC, font) AS r FROM b) WHERE r = 1")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dominant(lines(spark, sf_dir), ["page"], "font", "chars")


@query("A13_style_inventory", f"WITH {LINES} SELECT page, array_to_string(list_sort(list_distinct(list(font))), ',') AS fonts, median(font_size) AS median_size, min(font_size) AS least_size FROM lines GROUP BY page")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("page").agg(F.array_join(F.array_sort(F.collect_set("font")), ",").alias("fonts"), F.median("font_size").alias("median_size"), F.min("font_size").alias("least_size"))


@query("A14_bbox_union", f"WITH {LINES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM lines GROUP BY page")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("A18_document_structure", f"WITH {BLOCKS} SELECT doc_id, min(CASE WHEN contains(content, '|') THEN block_no END) AS first_table, max(page) AS pages, count(*) AS blocks FROM blocks GROUP BY doc_id")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).groupBy("doc_id").agg(F.min(F.when(F.col("content").contains("|"), F.col("block_no"))).alias("first_table"), F.max("page").alias("pages"), F.count("*").alias("blocks"))


@query("A19_heading_inventory", rf"WITH {BLOCKS} SELECT page, count(*) FILTER (WHERE NOT regexp_matches(content, '[.!?]$') AND length(content) < 60) AS headings, max(length(content)) AS longest FROM blocks GROUP BY page")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = ~F.col("content").rlike("[.!?]$") & (F.length("content") < 60)
    return blocks(spark, sf_dir).groupBy("page").agg(F.count_if(heading).alias("headings"), F.max(F.length("content")).cast("long").alias("longest"))


@query("A20_citation_inventory", r"""SELECT lang, sum(len(regexp_extract_all(text, '\[\d+(?:\s*[,-]\s*\d+)*\]'))) AS numeric_citations, sum(len(regexp_extract_all(text, '\([A-Z][A-Za-z]+(?: et al\.)?,? \d{4}\)'))) AS author_year_citations,
 sum(len(regexp_extract_all(text, 'https?://\S+'))) AS urls FROM documents GROUP BY lang""")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*[F.sum(c).alias(n) for n, c in X.citation_counts(F.col("text")).items()])


@query("A23_caption_numbering", """SELECT o_custkey, count(DISTINCT l_linenumber) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AS continuous FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    got = o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_custkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("numbers"))
    return got.select("o_custkey", F.size("numbers").cast("long").alias("n"), (F.col("numbers") == F.sequence(F.lit(1), F.array_max("numbers"))).alias("continuous"))


_FINDINGS = """findings AS (SELECT l_partkey % 200 AS rule_id, CASE l_returnflag WHEN 'R' THEN 'compliant' WHEN 'A' THEN 'unverifiable' ELSE CASE WHEN l_tax > 0.06 THEN 'non_compliant' ELSE 'not_applicable' END END AS result,
 CASE WHEN l_discount > 0.07 THEN 'high' WHEN l_discount > 0.04 THEN 'medium' WHEN l_discount > 0.02 THEN 'low' ELSE 'info' END AS severity, 'f' || l_orderkey AS finding, l_orderkey * 10 + l_linenumber AS unit_position, l_suppkey AS evidence_id, l_quantity > 3 AS complete FROM lineitem)"""


@query("A27_finding_consolidation", f"""WITH {_FINDINGS}, r AS (SELECT *, list_position(['not_applicable','unverifiable','compliant','non_compliant'], result) AS v, list_position(['info','low','medium','high'], severity) AS s FROM findings), k AS (SELECT * FROM (SELECT *, max(v) OVER (PARTITION BY rule_id) AS top FROM r) WHERE v = top)
 SELECT rule_id, any_value(result) AS result, arg_max(severity, s) AS severity, arg_min(finding, unit_position) AS finding, count(DISTINCT evidence_id) AS evidences, bool_and(complete) AS complete, min(unit_position) AS unit_position FROM k GROUP BY rule_id""")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    result = F.when(F.col("l_returnflag") == "R", "compliant").when(F.col("l_returnflag") == "A", "unverifiable").when(F.col("l_tax") > 0.06, "non_compliant").otherwise("not_applicable")
    severity = F.when(F.col("l_discount") > 0.07, "high").when(F.col("l_discount") > 0.04, "medium").when(F.col("l_discount") > 0.02, "low").otherwise("info")
    findings = li.select((F.col("l_partkey") % 200).alias("rule_id"), result.alias("result"), severity.alias("severity"), F.concat(F.lit("f"), "l_orderkey").alias("finding"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_position"), F.col("l_suppkey").alias("evidence_id"), (F.col("l_quantity") > 3).alias("complete"))
    return A.consolidate(findings)


@query("A28_coverage_report", "SELECT l_suppkey, 3 - count(DISTINCT l_returnflag) AS missing, count(DISTINCT l_returnflag) = 3 AS complete FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.array(*[F.lit(x) for x in "ANR"])
    seen = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("seen"))
    missing = F.size(F.array_except(expected, "seen"))
    return seen.select("l_suppkey", missing.cast("long").alias("missing"), (missing == 0).alias("complete"))


@query("A29_topk_coverage", """WITH r AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem), k AS (SELECT unnest([1, 2, 4]) AS k)
 SELECT k, round(count(DISTINCT CASE WHEN l_returnflag = 'R' AND rank <= k THEN l_orderkey END) / count(DISTINCT l_orderkey), 4) AS coverage FROM r, k GROUP BY k""")
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import top_per_group

    ranked = top_per_group(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_linenumber"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 1 << 30)
    each = ranked.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("rank"))).alias("best"))
    return each.select("l_orderkey", "best", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("k")).groupBy("k").agg(F.round(F.count_if(F.col("best") <= F.col("k")) / F.count("*"), 4).alias("coverage"))


@query("A30_evaluation_summary", "SELECT count(*) AS total, count(quality) AS executed, count(*) FILTER (WHERE quality = 1) AS passed, count(*) FILTER (WHERE quality = 0) AS failed, count(*) FILTER (WHERE quality IS NULL) AS not_run FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("total"), F.count("quality").alias("executed"), F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("quality").isNull()).alias("not_run"))


@query("A31_line_confidence", "SELECT l_suppkey, round(avg(l_discount), 6) AS confidence, count(*) FILTER (WHERE l_discount < 0.03) AS low FROM lineitem GROUP BY l_suppkey")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 6).alias("confidence"), F.count_if(F.col("l_discount") < 0.03).alias("low"))


@query("A32_dominant_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("A36_page_overflow", f"WITH {LINES} SELECT page, count(*) FILTER (WHERE x1 > 522 OR y1 > 702) AS overflow, count(*) AS n FROM lines GROUP BY page")
def a36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("page").agg(F.count_if((F.col("x1") > 522) | (F.col("y1") > 702)).alias("overflow"), F.count("*").alias("n"))


@query("A37_rule_assessment", f"WITH {LINES}, m AS (SELECT page, median(font_size) AS size, max(x1) AS edge FROM lines GROUP BY page) SELECT page, 'size' AS rule, CASE WHEN size BETWEEN 9 AND 11 THEN 'compliant' ELSE 'non_compliant' END AS result FROM m UNION ALL SELECT page, 'edge', CASE WHEN edge <= 540 THEN 'compliant' ELSE 'non_compliant' END FROM m")
def a37(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lines(spark, sf_dir).groupBy("page").agg(F.median("font_size").alias("size"), F.max("x1").alias("edge"))
    verdict = lambda ok: F.when(ok, "compliant").otherwise("non_compliant")
    rules = F.array(F.struct(F.lit("size").alias("rule"), verdict(F.col("size").between(9, 11)).alias("result")), F.struct(F.lit("edge").alias("rule"), verdict(F.col("edge") <= 540).alias("result")))
    return m.select("page", F.explode(rules).alias("r")).select("page", "r.rule", "r.result")
