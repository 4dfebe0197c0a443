"""Filters, joins, set operations, paging and replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..registry import query, table
from .fixtures import BLOCKS, blocks


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def _scope(spark: SparkSession, sf_dir: str, missing: bool) -> DataFrame:
    (c,) = _t(spark, sf_dir, "customer")
    owned = c.filter((F.col("c_nationkey") == 3) & (F.col("c_acctbal") > 0)).select("c_custkey", "c_name")
    wanted = owned.filter("c_custkey % 2 = 0").select("c_custkey")
    if missing:
        wanted = wanted.union(c.filter("c_nationkey = 4").agg(F.min("c_custkey")))
    return R.authorised(owned, wanted, "c_custkey")


_OWNED = "owned AS (SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0)"


@query("F01_authorised_scope", f"WITH {_OWNED} SELECT c_custkey, c_name FROM owned WHERE c_custkey % 2 = 0")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scope(spark, sf_dir, False)


@query("F01_unauthorised_scope_is_empty", f"WITH {_OWNED} SELECT c_custkey, c_name FROM owned WHERE false")
def f01b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scope(spark, sf_dir, True)


@query("F02_current_version", "SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) m ON o.o_custkey = m.o_custkey AND o.o_orderkey = m.k")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    current = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return o.join(current, ["o_custkey", "o_orderkey"], "left_semi").select("o_orderkey", "o_custkey")


@query("F03_list_filters", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def f03(spark: SparkSession, sf_dir: str, status: str | None = "F", least: float | None = 150000.0) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    if status is not None:
        o = o.filter(F.col("o_orderstatus") == status)
    if least is not None:
        o = o.filter(F.col("o_totalprice") > least)
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("F04_term_match", f"WITH {BLOCKS} SELECT doc_id, block_no FROM blocks WHERE contains(lower(concat_ws(' ', content, source)), 'license') OR contains(lower(concat_ws(' ', content, source)), 'src3')")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(F.lit("license"), F.lit("src3"))
    hay = F.lower(F.concat_ws(" ", "content", "source"))
    return blocks(spark, sf_dir).filter(F.exists(terms, lambda t: F.contains(hay, t))).select("doc_id", "block_no")


@query("F06_applicable_manifest", "SELECT p_partkey, p_name, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#22') AND p_name <> '' AND p_partkey IS NOT NULL")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = _t(spark, sf_dir, "part")
    return p.filter(F.col("p_brand").isin("Brand#11", "Brand#22") & (F.coalesce("p_name", F.lit("")) != "") & F.col("p_partkey").isNotNull()).select("p_partkey", "p_name", "p_type")


@query("F16_manifest_quarantine", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 0 THEN 'quantity' WHEN l_discount > 0.09 THEN 'discount' WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'date' END AS problem
 FROM lineitem WHERE l_quantity <= 0 OR l_discount > 0.09 OR l_shipdate < TIMESTAMP '1993-01-01'""")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    problem = F.when(F.col("l_quantity") <= 0, "quantity").when(F.col("l_discount") > 0.09, "discount").when(F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz"), "date")
    return li.select("l_orderkey", "l_linenumber", problem.alias("problem")).filter("problem is not null")


@query("J01_chunk_lookup", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = _t(spark, sf_dir, "lineitem", "part")
    return li.join(p.filter("p_size < 5"), li.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", "p_name")


@query("J02_authorised_lookup", """SELECT s_nationkey, count(*) FILTER (WHERE p_partkey IS NOT NULL) AS matched, count(*) FILTER (WHERE p_partkey IS NULL) AS out_of_scope
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) p ON l_partkey = p_partkey GROUP BY s_nationkey""")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s, p = _t(spark, sf_dir, "lineitem", "supplier", "part")
    joined = li.join(s, li.l_suppkey == s.s_suppkey).join(p.filter("p_size <= 25").select("p_partkey"), li.l_partkey == F.col("p_partkey"), "left")
    return joined.groupBy("s_nationkey").agg(F.count("p_partkey").alias("matched"), F.count_if(F.col("p_partkey").isNull()).alias("out_of_scope"))


@query("J03_media_left_ocr", "SELECT d.doc_id, l.quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _t(spark, sf_dir, "documents", "labels")
    return d.select("doc_id").join(lab, "doc_id", "left").select("doc_id", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("J15_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _t(spark, sf_dir, "documents", "labels")
    return d.join(lab.filter("quality = 0"), "doc_id", "left_semi").select("doc_id", "lang")


@query("J16_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.filter("o_totalprice > 400000"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("J21_inner_joins", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY n_name, r_name")
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = _t(spark, sf_dir, "customer", "nation", "region")
    return c.filter("c_acctbal > 0").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("J22_full_outer_counts", """SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers
 FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def j22(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer", "supplier")
    a = c.filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("J23_previous_results_reuse", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j23(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _t(spark, sf_dir, "documents", "labels")
    done = lab.select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    return R.remaining(d.select("doc_id", "n_chars"), done, ["doc_id"])


@query("J25_target_resolution", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j25(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = _t(spark, sf_dir, "lineitem", "orders")
    return li.join(o.filter("o_orderpriority = '1-URGENT'"), li.l_orderkey == o.o_orderkey, "left_semi").select("l_suppkey", "l_returnflag").distinct()


@query("T03_offset_paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    return R.page_of(o.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 20)


@query("T04_nulls_last", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.toxic DESC NULLS LAST, d.doc_id")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _t(spark, sf_dir, "documents", "labels")
    return d.select("doc_id").join(lab.select("doc_id", "toxic"), "doc_id", "left").orderBy(F.desc_nulls_last("toxic"), "doc_id")


@query("T05_latest_fifty", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = _t(spark, sf_dir, "events")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query("T05_latest_per_resource", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def t05b(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = _t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("T07_top_per_group", "SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 6")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = _t(spark, sf_dir, "documents")
    return R.top_per_group(d.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 6)


@query("T08_continuous_order", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS position FROM documents")
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = _t(spark, sf_dir, "documents")
    return R.numbered(d.select("doc_id", "n_chars"), [F.asc("n_chars"), F.asc("doc_id")]).select("doc_id", "position")


@query("T10_argmin", "SELECT p_brand, arg_min(p_partkey, p_retailprice * 1000000 + p_partkey) AS cheapest, arg_max(p_partkey, p_retailprice * 1000000 + p_partkey) AS dearest FROM part GROUP BY p_brand")
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = _t(spark, sf_dir, "part")
    cost = F.col("p_retailprice") * 1000000 + F.col("p_partkey")
    return p.groupBy("p_brand").agg(F.min_by("p_partkey", cost).alias("cheapest"), F.max_by("p_partkey", cost).alias("dearest"))


@query("U01_union_by_name", "SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _t(spark, sf_dir, "supplier", "customer")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("U02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


@query("U03_intersection", "SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'fr'")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, d = _t(spark, sf_dir, "labels", "documents")
    return lab.filter("quality = 1").select("doc_id").intersect(d.filter("lang = 'fr'").select("doc_id"))


@query("U04_difference", "SELECT doc_id FROM documents WHERE lang = 'de' EXCEPT SELECT doc_id FROM labels")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _t(spark, sf_dir, "documents", "labels")
    return d.filter("lang = 'de'").select("doc_id").join(lab.select("doc_id"), "doc_id", "left_anti").distinct()


@query("U05_disjoint_subset", """SELECT o_orderkey, bool_or(l_returnflag = 'R') AS overlaps, bool_and(l_returnflag IN ('A', 'N')) AS subset FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    flags = li.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return o.join(flags, o.o_orderkey == flags.l_orderkey).select("o_orderkey", F.arrays_overlap("flags", F.array(F.lit("R"))).alias("overlaps"), (F.size(F.array_except("flags", F.array(F.lit("A"), F.lit("N")))) == 0).alias("subset"))


@query("U06_delta_only", f"WITH {BLOCKS} SELECT DISTINCT source, content FROM blocks WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id % 2 = 0 AND b.source = blocks.source AND b.content = blocks.content)")
def u06(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return b.filter("doc_id % 2 = 1").select("source", "content").join(b.filter("doc_id % 2 = 0").select("source", "content"), ["source", "content"], "left_anti").distinct()


@query("U07_replace_subset", "SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_retailprice + 1 FROM part WHERE p_partkey % 3 = 0")
def u07(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = _t(spark, sf_dir, "part")
    fresh = p.filter("p_partkey % 3 = 0").select("p_partkey", (F.col("p_retailprice") + 1).alias("p_retailprice"))
    return R.replace_subset(p.select("p_partkey", "p_retailprice"), fresh, "p_partkey")


@query("K03_upsert_latest", """SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, fresh DESC) AS n FROM (
 SELECT user_id AS k, value AS v, event_id AS seq, 0 AS fresh FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, value, event_id, 1 FROM events WHERE event_id % 2 = 1)) WHERE n = 1""")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = _t(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("k"), F.col("value").alias("v"), F.col("event_id").alias("at"))
    return R.upsert(rows.filter("at % 2 = 0"), rows.filter("at % 2 = 1"), ["k"], "at").select("k", "v")


@query("K04_resumable_import", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 4 <> 0")
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = _t(spark, sf_dir, "documents")
    work = d.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    done = work.filter("doc_id % 4 = 0").withColumn("status", F.lit("ok")).union(work.filter("doc_id % 4 = 1").withColumn("status", F.lit("failed")))
    return R.remaining(work, done, ["doc_id", "content_hash"])


@query("K05_resume_same_settings", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0")
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = _t(spark, sf_dir, "documents")
    settings = F.sha2(F.to_json(F.struct(F.lit(8).alias("page_size"), F.lit(0.2).alias("threshold"))), 256)
    other = F.sha2(F.to_json(F.struct(F.lit(12).alias("page_size"), F.lit(0.0).alias("threshold"))), 256)
    work = d.select("doc_id", settings.alias("settings"))
    done = d.filter("doc_id % 4 < 2").select("doc_id", F.when(F.col("doc_id") % 4 == 0, settings).otherwise(other).alias("settings"), F.lit("ok").alias("status"))
    return R.remaining(work, done, ["doc_id", "settings"]).select("doc_id")


@query("K10_cascading_delete", f"WITH {BLOCKS} SELECT doc_id, block_no FROM blocks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return blocks(spark, sf_dir).join(gone, "doc_id", "left_anti").select("doc_id", "block_no")


@query("R19_upload_dedupe", "SELECT min(doc_id) AS doc_id, source, sha256(text) AS content_hash FROM documents GROUP BY source, sha256(text)")
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = _t(spark, sf_dir, "documents")
    return d.groupBy("source", F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"))


@query("R20_idempotent_replay", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'replay' WHEN event_id % 5 = 1 THEN 'conflict' ELSE 'proceed' END AS outcome FROM events""")
def r20(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = _t(spark, sf_dir, "events")
    asked = e.select("event_id", F.sha2(F.col("props"), 256).alias("request_hash"))
    kept = e.filter("event_id % 5 < 2").select("event_id", F.when(F.col("event_id") % 5 == 0, F.sha2(F.col("props"), 256)).otherwise("other").alias("request_hash"), F.lit("{}").alias("response"))
    return R.replay(asked, kept, ["event_id"]).select("event_id", "outcome")
