"""Retrieval, planning and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.relational import bundled, spread
from ..plans import retrieval
from ..registry import query, table
from .fixtures import BLOCKS, blocks

QUESTION = "what does the license say about the experiment, 4.0 or 50%?"
TERMS = ["what", "does", "the", "license", "say", "about", "experiment", "or", "4.0", "50%"]
_LIST = ", ".join(f"'{t}'" for t in TERMS)
_SCORED = f"""scored AS (SELECT doc_id, block_no, page, greatest(0.01, (CASE WHEN m > 0 THEN m / {len(TERMS)}.0 ELSE 0.01 END) * CASE WHEN source = 'src3' THEN 1.5 ELSE 1.0 END) AS score FROM (
 SELECT *, CAST(len(list_filter([{_LIST}], lambda t: contains(lower(content), t))) AS DOUBLE) AS m FROM blocks))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.score(blocks(spark, sf_dir).withColumn("weight", F.lit(1.0)).withColumn("section_role", F.lit("body")).withColumn("content_type", F.col("source")), QUESTION, ["src3"])


@query("R01_lexical_relevance", f"WITH {BLOCKS} SELECT doc_id, block_no, round(CASE WHEN m > 0 THEN m / {len(TERMS)}.0 ELSE 0.01 END, 6) AS relevance FROM (SELECT *, len(list_filter([{_LIST}], lambda t: contains(lower(content), t))) AS m FROM blocks)")
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*[F.lit(t) for t in TERMS])
    return blocks(spark, sf_dir).select("doc_id", "block_no", F.round(X.relevance(F.col("content"), terms), 6).alias("relevance"))


@query("R02_chunk_score", f"WITH {BLOCKS}, {_SCORED} SELECT doc_id, block_no, round(score, 6) AS score FROM scored")
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "block_no", F.round("score", 6).alias("score"))


@query("R03_retrieve_topk", f"WITH {BLOCKS}, {_SCORED} SELECT doc_id, block_no, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id, block_no LIMIT 15")
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(_scored(spark, sf_dir), ["doc_id", "block_no"], 15).select("doc_id", "block_no", F.round("score", 6).alias("score"))


@query("T02_fallback_order", f"WITH {BLOCKS} SELECT doc_id, block_no FROM blocks ORDER BY page, doc_id, block_no LIMIT 15")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = retrieval.score(blocks(spark, sf_dir).withColumn("weight", F.lit(1.0)).withColumn("section_role", F.lit("body")).withColumn("content_type", F.lit("text")), "zzqxv", [])
    return retrieval.top(none, ["page", "doc_id", "block_no"], 15).select("doc_id", "block_no")


@query("R04_relaxed_when_empty", f"WITH {BLOCKS}, {_SCORED} SELECT doc_id, block_no FROM (SELECT *, max(score) OVER () AS best FROM scored) WHERE score >= CASE WHEN best >= 0.95 THEN 0.95 ELSE 0.4 END")
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    cut = s.agg(F.when(F.max("score") >= 0.95, 0.95).otherwise(0.4).alias("cut"))
    return s.crossJoin(F.broadcast(cut)).filter("score >= cut").select("doc_id", "block_no")


@query("R05_hybrid_similarity", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(0.3 * list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) + 0.7 * CASE WHEN label = 3 THEN 1 ELSE 0 END, 6) AS score FROM embeddings, q
 WHERE 0.3 * list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) + 0.7 * CASE WHEN label = 3 THEN 1 ELSE 0 END >= 0.2""")
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    one = F.broadcast(v.filter("vec_id = 0").limit(1).select(F.col("embedding").alias("q")))
    cosine = retrieval.cosine(F.col("embedding"), F.col("q"))
    score = 0.3 * cosine + 0.7 * F.when(F.col("label") == 3, 1.0).otherwise(0.0)
    return v.crossJoin(one).withColumn("score", score).filter("score >= 0.2").select("vec_id", F.round("score", 6).alias("score"))


@query("R06_intent_routing", r"SELECT conv_id, turn, CASE WHEN contains(lower(text), 'compare') THEN 'compare' WHEN contains(lower(text), 'review') THEN 'review' WHEN regexp_matches(text, '\?') THEN 'question' ELSE 'chat' END AS route FROM conversations WHERE role = 'user'")
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    route = F.when(low.contains("compare"), "compare").when(low.contains("review"), "review").when(F.col("text").contains("?"), "question").otherwise("chat")
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", route.alias("route"))


@query("R09_context_ranking", f"""WITH {BLOCKS}, s AS (SELECT doc_id, block_no, page, 8 * (CAST(contains(lower(content), 'license') AS INTEGER) + CAST(contains(lower(content), 'the') AS INTEGER)) + CASE WHEN contains(content, '|') THEN 8 ELSE 0 END + CASE WHEN length(content) < 60 THEN 2 ELSE 0 END AS score FROM blocks)
 SELECT doc_id, block_no, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page, block_no) AS n FROM s) WHERE n <= 8 AND score > 0""")
def r09(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(F.lit("license"), F.lit("the"))
    score = 8 * F.size(F.filter(terms, lambda t: F.contains(F.lower("content"), t))) + F.when(F.col("content").contains("|"), 8).otherwise(0) + F.when(F.length("content") < 60, 2).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "page", "block_no")
    return blocks(spark, sf_dir).withColumn("score", score.cast("long")).withColumn("n", F.row_number().over(w)).filter("n <= 8 and score > 0").select("doc_id", "block_no", "score")


@query("R10_evidence_gate", """WITH g AS (SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS k FROM lineitem GROUP BY 1, 2) SELECT l.l_orderkey, l.l_linenumber, CASE WHEN p_size > 30 AND l_tax > 0.02 THEN CASE WHEN l_returnflag = 'R' THEN 'non_compliant' ELSE 'compliant' END ELSE 'unverifiable' END AS result
 FROM lineitem l JOIN g ON l.l_orderkey * 10 + l.l_linenumber = g.k AND l.l_partkey = g.l_partkey AND l.l_suppkey = g.l_suppkey JOIN part ON p_partkey = l.l_partkey""")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import first_wins

    li = first_wins(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], [F.asc(F.col("l_orderkey") * 10 + F.col("l_linenumber"))])
    j = li.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    complete = (F.col("p_size") > 30) & (F.col("l_tax") > 0.02)
    result = F.when(complete, F.when(F.col("l_returnflag") == "R", "non_compliant").otherwise("compliant")).otherwise("unverifiable")
    return j.select("l_orderkey", "l_linenumber", result.alias("result"))


@query("R11_represent_every_rule", "SELECT p_partkey AS rule_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') THEN 'assessed' ELSE 'unverifiable' END AS result FROM part")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"))
    seen = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("rule_id")).distinct()
    return rules.join(seen, "rule_id", "left_semi").withColumn("result", F.lit("assessed")).unionByName(rules.join(seen, "rule_id", "left_anti").withColumn("result", F.lit("unverifiable")))


@query("R13_citation_validation", """SELECT o_orderkey AS claim_id, CASE WHEN bool_or(p_partkey IS NULL) THEN 'unknown' WHEN NOT bool_or(p_size > 25) THEN 'no_paper' ELSE 'ok' END AS outcome FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM part WHERE p_partkey % 17 <> 0) p ON p_partkey = l_partkey GROUP BY o_orderkey""")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("claim_id"), F.col("l_partkey").alias("evidence_id"))
    evidence = table(spark, sf_dir, "part").filter("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("evidence_id"), F.when(F.col("p_size") > 25, "paper").otherwise("standard").alias("kind"))
    per = claims.join(evidence, "evidence_id", "left").groupBy("claim_id").agg(F.bool_or(F.col("kind").isNull()).alias("unknown"), F.bool_or(F.coalesce(F.col("kind") == "paper", F.lit(False))).alias("paper"))
    return per.select("claim_id", F.when(F.col("unknown"), "unknown").when(~F.col("paper"), "no_paper").otherwise("ok").alias("outcome"))


@query("R14_numeric_support")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each conversation's answers that its questions don't hold."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat_ws(" ", F.collect_list(F.when(F.col("role") == "user", F.col("text")))).alias("cited"), F.concat_ws(" ", F.collect_list(F.when(F.col("role") == "assistant", F.col("text")))).alias("claim"))
    return c.select("conv_id", F.array_sort(F.array_except(X.numbers_in(F.col("claim")), X.numbers_in(F.col("cited")))).alias("unsupported"))


@query("R15_answerability", "SELECT conv_id, turn, trim(text) = '' AS blank, length(text) > 20000 AS too_long FROM conversations WHERE role = 'assistant'")
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", (F.trim("text") == "").alias("blank"), (F.length("text") > 20000).alias("too_long"))


@query("R15_repeated_characters")
def r15b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"(?s)(.)\1{20,}").alias("repeated"))


@query("R16_golden_scoring", "SELECT item_id, count(doc_id) AS hits, count(doc_id) > 0 AS passed FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.containment import containing

    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    hits = containing(table(spark, sf_dir, "documents").select("doc_id", "text"), items, "text", "needle").groupBy("item_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", n.alias("hits"), (n > 0).alias("passed"))


@query("J17_text_containment", "SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id HAVING count(*) = 1")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.containment import containing

    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    hits = containing(table(spark, sf_dir, "documents").select("doc_id", "text"), items, "text", "needle")
    return hits.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).filter("n = 1").select("item_id", "doc_id")


@query("J06_case_to_result", "SELECT b.item_id, coalesce(d.doc_id, -1) AS doc_id FROM benchmark b LEFT JOIN (SELECT lower(regexp_replace(text, '\\s+', '', 'g')) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1) d ON lower(regexp_replace(b.text, '\\s+', '', 'g')) = d.k")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(X.compact_key(F.col("text")).alias("k")).agg(F.min("doc_id").alias("doc_id"))
    b = table(spark, sf_dir, "benchmark").select("item_id", X.compact_key(F.col("text")).alias("k"))
    return b.join(d, "k", "left").select("item_id", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))


@query("J14_rule_allocation", """WITH rules AS (SELECT p_partkey AS rule_id, p_size % 7 AS kind FROM part), units AS (SELECT s_suppkey AS unit_id, s_suppkey % 5 AS kind FROM supplier) SELECT rule_id, unit_id FROM rules JOIN units USING (kind) UNION ALL SELECT rule_id, -1 FROM rules WHERE kind NOT IN (SELECT kind FROM units)""")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and units of a kind. There are five kinds that meet, so bundles of rules are dealt to tasks by themselves, not
    by kind, and meet bundles of the broadcast units (two integers each) where they are."""
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") % 7).cast("long").alias("kind"))
    units = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit_id"), (F.col("s_suppkey") % 5).alias("kind"))
    none = rules.join(F.broadcast(units.select("kind").distinct()), "kind", "left_anti").select("rule_id", F.lit(-1).cast("long").alias("unit_id"))
    # numbered by kind and range of ids, so that no task sorts all rules of a kind
    dealt = spread(bundled(rules.withColumn("_range", F.floor(F.col("rule_id") / 65536)), ["kind", "_range"], "rule_id", 64).drop("_range"))
    met = dealt.join(F.broadcast(bundled(units, ["kind"], "unit_id", 512)), "kind")
    pairs = met.select(F.explode("rule_id").alias("_rule"), "unit_id").select("_rule", F.explode("unit_id").alias("_unit"))
    return pairs.select("_rule.rule_id", "_unit.unit_id").unionByName(none)


@query("J18_standard_resolution", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.05 THEN l_partkey END, CASE WHEN l_discount > 0.05 THEN l_suppkey END, -1) AS standard_id FROM lineitem")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.when(F.col("l_tax") > 0.05, F.col("l_partkey")), F.when(F.col("l_discount") > 0.05, F.col("l_suppkey")), F.lit(-1)).alias("standard_id"))


@query("J19_evidence_in_order", "SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY l_linenumber, p_name) AS quotes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name")))
    return j.groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda p: p["p_name"]), "; ").alias("quotes"))


@query("J20_facts_for_unit", "SELECT DISTINCT unit, fact FROM (SELECT l_suppkey AS unit, l_orderkey AS fact FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT s_suppkey, l_orderkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_quantity > 45)")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    own = li.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("unit"), F.col("l_orderkey").alias("fact"))
    more = table(spark, sf_dir, "supplier").join(li.filter("l_quantity > 45"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_suppkey").alias("unit"), F.col("l_orderkey").alias("fact"))
    return own.union(more).distinct()


@query("R07_unit_planning", f"WITH {BLOCKS} SELECT doc_id, CASE WHEN block_no = 0 THEN 'front' WHEN contains(content, '|') THEN 'tables' ELSE 'body' END AS kind, count(*) AS blocks, min(page) AS first_page, max(page) AS last_page FROM blocks GROUP BY 1, 2")
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("block_no") == 0, "front").when(F.col("content").contains("|"), "tables").otherwise("body")
    return blocks(spark, sf_dir).groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("blocks"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query("R17_standard_materialisation", "SELECT p_partkey AS rule_id, 'S' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS evidence_id, 1.0::DOUBLE AS score FROM part WHERE p_size < 10")
def r17(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("rule_id"), F.concat(F.lit("S"), F.row_number().over(w)).alias("evidence_id"), F.lit(1.0).alias("score"))
