"""Retrieval inside authorised scopes and routing of questions, for every message of a user at once.

Papers are `documents` with owners and states, chunks their blocks, requests the messages of `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import retrieval, routing
from ..registry import query, table
from .evidence import QUESTION, TERMS
from .fixtures import BLOCKS, blocks

# The questions, the terms they hold and the section roles they ask for.
QUESTIONS = [(QUESTION, TERMS, "experiment"), ("zzqxv", ["zzqxv"], None), ("which method and data", ["which", "method", "and", "data"], "method"), ("conclusion, 42% of it?", ["conclusion", "of", "it", "42%"], "conclusion")]

_TERMS = "CASE conv_id % 4 " + " ".join(f"WHEN {i} THEN [{', '.join(repr(t) for t in terms)}]" for i, (_, terms, _) in enumerate(QUESTIONS)) + " END"
_ROLE = "CASE conv_id % 4 " + " ".join(f"WHEN {i} THEN '{role or 'none'}'" for i, (_, _, role) in enumerate(QUESTIONS)) + " END"
SCOPES = f"""{BLOCKS}, req AS (SELECT conv_id * 1000 + turn AS request_id, conv_id, conv_id % 5 AS user_id, turn % 4 = 2 AS relaxed, conv_id % 2 = 0 AS prefers, {_TERMS} AS terms, {_ROLE} AS role,
   list_concat([conv_id % 5 + 5 * ((conv_id * 7 + turn) % 30), conv_id % 5 + 5 * ((conv_id * 7 + turn) % 30) + 5], CASE WHEN conv_id % 11 = 0 THEN [-1] ELSE [] END) AS paper_ids FROM conversations WHERE role = 'user'),
 papers AS (SELECT doc_id AS paper_id, doc_id % 5 AS owner_id, doc_id % 9 <> 4 AND doc_id % 23 <> 7 AS usable, CASE WHEN doc_id % 17 <> 0 THEN doc_id % 3 END AS version, CASE WHEN doc_id % 4 <> 1 THEN left(text, 20) END AS summary FROM documents),
 want AS (SELECT request_id, user_id, unnest(list_distinct(paper_ids)) AS paper_id FROM req), held AS (SELECT want.*, version, summary FROM want JOIN papers ON papers.paper_id = want.paper_id AND owner_id = user_id AND usable),
 okay AS (SELECT request_id FROM (SELECT request_id, count(*) AS n FROM held GROUP BY 1) JOIN req USING (request_id) WHERE n = len(list_distinct(paper_ids))),
 chunks AS (SELECT doc_id AS paper_id, CASE WHEN block_no % 6 = 5 THEN 99 ELSE doc_id % 3 END AS version, doc_id * 1000000 + block_no AS chunk_id, page, content, CASE block_no % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'Experiments' WHEN 2 THEN 'conclusion' END AS section_role, source AS content_type, CASE WHEN block_no % 7 = 3 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, block_no % 8 <> 7 AS indexable FROM blocks)"""


def _scopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    conv, turn, no, doc = F.col("conv_id"), F.col("turn"), F.col("block_no"), F.col("doc_id")
    question = F.lit(None).cast("string")
    for i, (text, _, _) in enumerate(QUESTIONS):
        question = F.when(conv % 4 == i, F.lit(text)).otherwise(question)
    first = conv % 5 + 5 * ((conv * 7 + turn) % 30)
    papers_of = F.concat(F.array(first, first + 5), F.when(conv % 11 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    requests = c.select((conv * 1000 + turn).alias("request_id"), (conv % 5).alias("user_id"), papers_of.alias("paper_ids"), question.alias("question"), (turn % 4 == 2).alias("relaxed"), F.when(conv % 2 == 0, F.array(F.lit("src3"))).alias("preferred"))
    d = table(spark, sf_dir, "documents")
    papers = d.select(doc.alias("paper_id"), (doc % 5).alias("owner_id"), F.when(doc % 9 != 4, "ready").otherwise("processing").alias("status"), F.when(doc % 23 == 7, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"), F.when(doc % 17 != 0, doc % 3).alias("version"), F.when(doc % 4 != 1, F.substring("text", 1, 20)).alias("summary"))
    role = F.when(no % 4 == 0, "method").when(no % 4 == 1, "Experiments").when(no % 4 == 2, "conclusion")
    chunks = blocks(spark, sf_dir).select(doc.alias("paper_id"), F.when(no % 6 == 5, 99).otherwise(doc % 3).alias("version"), (doc * 1000000 + no).alias("chunk_id"), "page", "content", role.alias("section_role"), F.col("source").alias("content_type"), F.when(no % 7 == 3, 0.5).otherwise(1.0).alias("weight"), (no % 8 != 7).alias("indexable"))
    return requests, papers, chunks


_ITEMS = f"""{SCOPES}, met AS (SELECT r.request_id, r.relaxed, c.*, greatest(0.01, CASE WHEN len(list_filter(terms, lambda t: contains(lower(content), t))) > 0 THEN len(list_filter(terms, lambda t: contains(lower(content), t)))::DOUBLE / len(terms) ELSE 0.01 END * CASE WHEN contains(lower(coalesce(section_role, '')), r.role) THEN 2.0 ELSE 1.0 END * CASE WHEN prefers AND content_type = 'src3' THEN 1.5 ELSE 1.0 END * greatest(weight, 0.01)) AS score
   FROM held h JOIN okay USING (request_id) JOIN req r USING (request_id) JOIN chunks c ON c.paper_id = h.paper_id AND c.version = h.version WHERE indexable),
 m AS (SELECT *, max(score) OVER (PARTITION BY request_id) AS best FROM met), k AS (SELECT *, CASE WHEN best > 0.01 THEN row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, paper_id, page, chunk_id) ELSE row_number() OVER (PARTITION BY request_id ORDER BY page, chunk_id) END AS rank FROM m),
 items AS (SELECT request_id, CAST(rank AS INTEGER) AS rank, paper_id, chunk_id, page, round(score, 6) AS score, 'paper://' || paper_id || '/' || chunk_id AS uri FROM k WHERE rank <= CASE WHEN relaxed THEN 24 ELSE 15 END)"""


@query("R03_scoped_retrieval", f"WITH {_ITEMS} SELECT * FROM items")
def r03_scoped_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every message is given from the papers it may read."""
    return retrieval.retrieve(*_scopes(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("R03_scope_outcomes", f"WITH {_ITEMS}, n AS (SELECT request_id, count(*) AS n_items FROM items GROUP BY 1), s AS (SELECT request_id, coalesce(string_agg(summary, chr(10) || chr(10) ORDER BY paper_id) FILTER (summary <> ''), '') AS paper_summary FROM held JOIN okay USING (request_id) GROUP BY 1) SELECT r.request_id, r.relaxed, coalesce(n_items, 0) AS n_items, coalesce(paper_summary, '') AS paper_summary, CASE WHEN s.request_id IS NULL THEN 'authorized paper scope is unavailable' ELSE '' END AS warnings FROM req r LEFT JOIN s ON s.request_id = r.request_id LEFT JOIN n ON n.request_id = r.request_id")
def r03_scope_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message's scope: items, summaries, and why it is given nothing."""
    requests, papers, chunks = _scopes(spark, sf_dir)
    found = retrieval.outcomes(requests, papers, retrieval.retrieve(requests, papers, chunks))
    return found.withColumn("warnings", F.array_join("warnings", "; "))


_HEADS = ["why does the method work, ", "and what about that, ", "please REVIEW its weakness, ", "the 实验 of this paper, ", "hello, ", "它的结论呢 "]
_ASKED = "CASE turn % 6 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADS)) + " END || text"
_WORDS = lambda words: "(" + " OR ".join(f"contains(lower(q), '{w}')" for w in words) + ")"


@query("R06_fallback_routes", f"""WITH t AS (SELECT conv_id, turn, {_ASKED} AS q, CASE WHEN conv_id % 3 > 0 THEN left(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 30) END AS s FROM conversations), f AS (SELECT *, coalesce(s, '') <> '' AND {_WORDS(routing.FOLLOW_UP)} AS follows, {_WORDS(routing.EVALUATION)} AS judges FROM t),
 i AS (SELECT *, CASE WHEN follows THEN 'follow_up' WHEN judges THEN 'fact' WHEN {_WORDS(routing.PAPER)} THEN CASE WHEN {_WORDS(routing.EXPLAIN)} THEN 'explain' ELSE 'fact' END ELSE 'general_chat' END AS initial FROM f)
 SELECT conv_id, turn, initial, CASE WHEN follows THEN 'fact' ELSE initial END AS effective, CASE WHEN follows THEN '基于会话上下文（' || s || '），回答：' || q ELSE q END AS standalone, CASE WHEN judges AND NOT follows THEN 2 ELSE 1 END AS n_warnings FROM i""")
def r06_fallback_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of all messages, each with a beginning that some rule of the ladder knows."""
    head = F.lit(None).cast("string")
    for i, h in enumerate(_HEADS):
        head = F.when(F.col("turn") % 6 == i, F.lit(h)).otherwise(head)
    before = F.when(F.col("conv_id") % 3 > 0, F.substring(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), 1, 30))
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(head, "text").alias("q"), before.alias("s"))
    r = given.select("conv_id", "turn", routing.route(F.col("q"), F.col("s")).alias("r"))
    return r.select("conv_id", "turn", "r.initial", "r.effective", "r.standalone", F.size("r.warnings").alias("n_warnings"))
