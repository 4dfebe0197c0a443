"""Order-dependent queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import order as O
from ..operators.relational import first_wins
from ..registry import query, table
from .fixtures import BLOCKS, LINES, blocks, lines


@query("W01_prev_next_links", f"WITH {BLOCKS} SELECT doc_id, block_no, lag(block_no) OVER w AS previous, lead(block_no) OVER w AS next FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY page, block_no)")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.linked(blocks(spark, sf_dir), ["doc_id"], [F.asc("page"), F.asc("block_no")], "block_no").select("doc_id", "block_no", "previous", "next")


_TOKENS = rf"len(regexp_extract_all(content, '[A-Za-z0-9_]+'))"


@query("W02_greedy_packing", rf"""WITH RECURSIVE {BLOCKS}, t AS (SELECT doc_id, block_no, greatest(1, len(regexp_extract_all(content, '[A-Za-z0-9_]+')) + (len(regexp_extract_all(content, '[\x{{3400}}-\x{{9fff}}]')) + 1) // 2 + len(regexp_extract_all(content, '[^\p{{L}}\p{{M}}\p{{N}}_\s\x{{3400}}-\x{{9fff}}]')) // 4) AS n,
 row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS i FROM blocks),
 f AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS pack, CAST(n AS BIGINT) AS run, n >= 350 AS shut FROM t WHERE i = 1 UNION ALL
  SELECT t.doc_id, t.i, CASE WHEN f.shut OR f.run + t.n > 550 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.shut OR f.run + t.n > 550 THEN t.n ELSE f.run + t.n END,
   CASE WHEN f.shut OR f.run + t.n > 550 THEN t.n >= 350 ELSE f.run + t.n >= 350 END FROM f JOIN t ON t.doc_id = f.doc_id AND t.i = f.i + 1),
 p AS (SELECT f.doc_id, f.pack, sum(t.n) AS n FROM f JOIN t USING (doc_id, i) GROUP BY 1, 2), q AS (SELECT *, max(pack) OVER (PARTITION BY doc_id) AS top, lag(n) OVER (PARTITION BY doc_id ORDER BY pack) AS before FROM p),
 m AS (SELECT doc_id, CASE WHEN pack = top AND pack > 0 AND n < 350 AND before + n <= 550 THEN pack - 1 ELSE pack END AS pack, n FROM q)
 SELECT doc_id, CAST(pack AS INTEGER) AS pack, CAST(sum(n) AS BIGINT) AS tokens FROM m GROUP BY 1, 2""")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = blocks(spark, sf_dir).withColumn("tokens", X.estimate_tokens(F.col("content")))
    return O.pack_tokens(t, ["doc_id"], "block_no", "tokens", 350, 550).select("doc_id", "pack", "tokens")


@query("W03_section_parents", f"WITH {BLOCKS} SELECT doc_id, page, md5(string_agg(content, chr(10) ORDER BY block_no)) AS content_md5, min(block_no) AS first_block, max(block_no) AS last_block FROM blocks GROUP BY doc_id, page")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("block_no", "content")))
    return blocks(spark, sf_dir).groupBy("doc_id", "page").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["content"]), "\n")).alias("content_md5"), F.min("block_no").alias("first_block"), F.max("block_no").alias("last_block"))


@query("W04_adjacent_differences", f"WITH {LINES} SELECT page, line_id, y0 - lag(y1) OVER (PARTITION BY page ORDER BY y0, x0, line_id) AS gap FROM lines")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page").orderBy("y0", "x0", "line_id")
    return lines(spark, sf_dir).select("page", "line_id", (F.col("y0") - F.lag("y1").over(w)).alias("gap"))


@query("W06_continuation_merge", f"""WITH {BLOCKS}, s AS (SELECT *, sum(CASE WHEN block_no % 3 = 0 OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS entry FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS rn FROM blocks))
 SELECT doc_id, CAST(entry AS BIGINT) AS entry, md5(string_agg(content, ' ' ORDER BY block_no)) AS content_md5, count(*) AS rows FROM s GROUP BY doc_id, entry""")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = O.merge_continuations(blocks(spark, sf_dir), ["doc_id"], "block_no", F.col("block_no") % 3 == 0, "content")
    return merged.select("doc_id", "entry", F.md5("content").alias("content_md5"), "rows")


@query("W07_reading_order", f"""WITH {LINES}, d AS (SELECT DISTINCT page, round(x0, 2) AS x FROM lines), g AS (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) - x AS gap FROM d), b AS (SELECT page, max(gap) AS gap FROM g GROUP BY page), c AS (SELECT g.page, min(g.x + g.gap / 2) AS cut FROM g JOIN b ON g.page = b.page AND g.gap = b.gap WHERE b.gap >= 24 GROUP BY g.page)
 SELECT lines.page, line_id, row_number() OVER (PARTITION BY lines.page ORDER BY CASE WHEN x0 > coalesce(cut, 1e9) THEN 1 ELSE 0 END, y0, x0, line_id) AS position FROM lines LEFT JOIN c ON lines.page = c.page""")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines(spark, sf_dir)
    w = Window.partitionBy("page").orderBy("x")
    gaps = ls.select("page", F.round("x0", 2).alias("x")).distinct().withColumn("gap", F.lead("x").over(w) - F.col("x")).filter("gap is not null")
    cut = gaps.groupBy("page").agg(F.max_by(F.col("x") + F.col("gap") / 2, F.struct("gap", -F.col("x"))).alias("cut"), F.max("gap").alias("gap")).filter("gap >= 24").drop("gap")
    column = F.when(F.col("x0") > F.coalesce("cut", F.lit(1e9)), 1).otherwise(0)
    order = Window.partitionBy("page").orderBy(column, "y0", "x0", "line_id")
    return ls.join(cut, "page", "left").select("page", "line_id", F.row_number().over(order).alias("position"))


@query("W09_budget_prefix", f"""WITH {BLOCKS}, c AS (SELECT *, least(length(content), 350) AS size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS n FROM blocks) WHERE n <= 10), r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
 SELECT doc_id, block_no, CAST(least(size, 1200 - before) AS BIGINT) AS taken FROM r WHERE before < 1200""")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.budget_prefix(blocks(spark, sf_dir), ["doc_id"], [F.asc("block_no")], F.length("content"), 10, 350, 1200).select("doc_id", "block_no", F.col("taken").cast("long"))


@query("W10_last_turns", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, md5(right(string_agg(role || ': ' || text, chr(10) ORDER BY turn), 6000)) AS tail FROM r WHERE n <= 8 GROUP BY conv_id""")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import top_per_group

    last = top_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 8)
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return last.groupBy("conv_id").agg(F.md5(F.right(F.array_join(F.transform(parts, lambda p: p["line"]), "\n"), F.lit(6000))).alias("tail"))


@query("W11_page_coverage_pick", f"""WITH {LINES}, p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY chars DESC, line_id) AS n FROM lines) SELECT line_id, page FROM (SELECT line_id, page, row_number() OVER (ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, chars DESC, line_id) AS r FROM p) WHERE r <= 80""")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page").orderBy(F.desc("chars"), "line_id")
    return lines(spark, sf_dir).withColumn("n", F.row_number().over(w)).orderBy(F.when(F.col("n") == 1, 0).otherwise(1), F.desc("chars"), "line_id").limit(80).select("line_id", "page")


@query("W13_first_wins", "SELECT content_hash, doc_id FROM (SELECT sha256(text) AS content_hash, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return first_wins(d, ["content_hash"], [F.asc("doc_id")])


@query("W14_sequential_ids", f"WITH {BLOCKS} SELECT doc_id, block_no, printf('u-%03d', row_number() OVER (PARTITION BY doc_id ORDER BY block_no)) AS unit_id FROM blocks")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "block_no", F.format_string("u-%03d", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))).alias("unit_id"))


@query("W15_event_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("sequence"))


@query("J12_section_as_of", f"WITH {BLOCKS} SELECT doc_id, block_no, last_value(CASE WHEN length(content) < 60 THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS section FROM blocks")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.as_of(blocks(spark, sf_dir), ["doc_id"], [F.asc("block_no")], F.length("content") < 60, F.col("content"), "section").select("doc_id", "block_no", "section")


@query("P05_context_window", f"WITH {BLOCKS} SELECT doc_id, block_no, md5(coalesce(string_agg(content, ' ') OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '')) AS context FROM blocks")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(-2, 2)
    return blocks(spark, sf_dir).select("doc_id", "block_no", F.md5(F.array_join(F.collect_list("content").over(w), " ")).alias("context"))


@query("J05_nearest_paragraphs", f"""WITH {BLOCKS}, b AS (SELECT doc_id, block_no, contains(content, '|') AS media FROM blocks), c AS (SELECT m.doc_id, m.block_no, p.block_no AS near, row_number() OVER (PARTITION BY m.doc_id, m.block_no ORDER BY abs(p.block_no - m.block_no), p.block_no) AS n FROM b m JOIN b p ON m.doc_id = p.doc_id AND NOT p.media WHERE m.media)
 SELECT doc_id, block_no, near, n AS rank FROM c WHERE n <= 4""")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest four paragraphs of each media block at any distance: paragraphs are numbered within the
    document, and only the four numbers on either side are looked up."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    b = blocks(spark, sf_dir).select("doc_id", "block_no", F.col("content").contains("|").alias("media"))
    b = b.withColumn("nth", F.sum(F.when(F.col("media"), 0).otherwise(1)).over(w))
    p = b.filter(~F.col("media")).select("doc_id", "nth", F.col("block_no").alias("near"))
    m = b.filter("media").select("doc_id", "block_no", F.explode(F.sequence(F.col("nth") - 3, F.col("nth") + 4)).alias("nth"))
    order = Window.partitionBy("doc_id", "block_no").orderBy(F.abs(F.col("near") - F.col("block_no")), "near")
    return m.join(p, ["doc_id", "nth"]).withColumn("rank", F.row_number().over(order)).filter("rank <= 4").select("doc_id", "block_no", "near", "rank")
