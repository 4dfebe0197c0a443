"""Authorised scopes, fallbacks and limits of retrieval, and every branch of the routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.plans import retrieval
from quirework.plans.routing import EVALUATED, FALLBACK, route

PAPERS = [(1, 7, "ready", None, 2, "first"), (2, 7, "ready", None, 1, ""), (3, 7, "processing", None, 1, "x"), (4, 7, "ready", "2024-01-01", 1, "x"), (5, 8, "ready", None, 1, "other's"), (6, 7, "ready", None, None, None)]
CHUNKS = [(1, 2, 10 + i, 1 + i // 4, "needle text" if i == 9 else "text", "Method" if i == 3 else None, "table" if i == 5 else "text", 1.0, i != 6) for i in range(30)] + [(1, 1, 90, 1, "needle", None, "text", 1.0, True), (2, 1, 91, 5, "needle", None, "text", 0.1, True)]
REQUESTS = [
    (1, 7, [1, 2], "needle", False, None), (2, 7, [1, 3], "needle", False, None), (3, 7, [1, 4], "needle", False, None), (4, 7, [1, 5], "needle", True, None), (5, 7, [1, 99], "needle", False, None), (6, 8, [5], "needle", False, None),
    (7, 7, [1, 1], "zzz", False, None), (8, 7, [1], "zzz", True, None), (9, 7, [1, 2], "text method", False, ["table"]), (10, 7, [6], "needle", False, None), (11, 7, [], "needle", False, None), (12, 7, None, None, None, None),
]


def frames(spark):  # noqa: ANN001, ANN201
    requests = spark.createDataFrame(REQUESTS, "request_id int, user_id int, paper_ids array<int>, question string, relaxed boolean, preferred array<string>")
    papers = spark.createDataFrame(PAPERS, "paper_id int, owner_id int, status string, deleted_at string, version int, summary string")
    chunks = spark.createDataFrame(CHUNKS, "paper_id int, version int, chunk_id int, page int, content string, section_role string, content_type string, weight double, indexable boolean")
    return requests, papers, chunks


def test_scopes_and_ranks(spark):  # noqa: ANN001, ANN201
    requests, papers, chunks = frames(spark)
    found = retrieval.retrieve(requests, papers, chunks).orderBy("request_id", "rank").collect()
    of = {q: [(r["chunk_id"], round(r["score"], 6)) for r in found if r["request_id"] == q] for q in range(1, 13)}
    assert of[1][:2] == [(19, 1.0), (91, 0.1)] and len(of[1]) == 15 and 90 not in dict(of[1])  # an old version's chunk is not there
    assert not any(of[q] for q in (2, 3, 4, 5, 6, 10, 11, 12))  # one paper that isn't the user's, ready and there closes the scope
    assert [c for c, _ in of[7]] == [10, 11, 12, 13, 14, 15, 17, 18, 19, 20, 21, 22, 23, 24, 25] and {s for _, s in of[7]} == {0.01}  # nothing matches: by page, without what isn't indexable
    assert len(of[8]) == 24
    assert of[9][:3] == [(13, 1.0), (15, 0.75), (10, 0.5)]  # a section the question asks for, a preferred type, then by page
    assert found[0]["uri"] == "paper://1/19"


def test_outcomes(spark):  # noqa: ANN001, ANN201
    requests, papers, chunks = frames(spark)
    found = {r["request_id"]: (r["n_items"], r["paper_summary"], len(r["warnings"])) for r in retrieval.outcomes(requests, papers, retrieval.retrieve(requests, papers, chunks)).collect()}
    assert found == {1: (15, "first", 0), 2: (0, "", 1), 3: (0, "", 1), 4: (0, "", 1), 5: (0, "", 1), 6: (0, "other's", 0), 7: (15, "first", 0), 8: (24, "first", 0), 9: (15, "first", 0), 10: (0, "", 0), 11: (0, "", 0), 12: (0, "", 0)}


def test_routes(spark):  # noqa: ANN001, ANN201
    cases = {
        ("Why does the METHOD work?", ""): ("explain", "explain"), ("list the dataset", None): ("fact", "fact"), ("what about that?", "s"): ("follow_up", "fact"), ("what about that?", ""): ("general_chat", "general_chat"), ("what about that paper?", ""): ("fact", "fact"),
        ("review that", "s"): ("follow_up", "fact"), ("give a score", "s"): ("fact", "fact"), ("why this score", ""): ("fact", "fact"), ("论文的机制", ""): ("explain", "explain"), ("hello", "s"): ("general_chat", "general_chat"), (None, None): ("general_chat", "general_chat"),
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, q string, s string").select("i", "q", "s", route(F.col("q"), F.col("s")).alias("r")).orderBy("i").collect()
    assert [(r["r"]["initial"], r["r"]["effective"]) for r in df] == list(cases.values())
    assert df[2]["r"]["standalone"] == "基于会话上下文（s），回答：what about that?" and df[0]["r"]["standalone"] == "Why does the METHOD work?" and df[10]["r"]["standalone"] == ""
    assert df[6]["r"]["warnings"] == [FALLBACK, EVALUATED] and df[5]["r"]["warnings"] == [FALLBACK] and {r["r"]["confidence"] for r in df} == {0.55}
