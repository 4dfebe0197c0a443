"""Ranking chunks for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def score(chunks: DataFrame, question: str, preferred: list[str]) -> DataFrame:
    """Adds ``score``: share of the question's terms, doubled where the question asks for the section's
    role, times 1.5 for preferred types, times the chunk's weight; 0.01 at least.

    The question is one literal, so its terms fold to a constant when the plan is made."""
    terms = X.question_terms(F.lit(question))
    base = X.relevance(F.col("content"), terms)
    asked = [role for role, words in X.QUESTION_ROLES.items() if any(w in question.lower() for w in words)]
    role = F.lower(F.coalesce("section_role", F.lit("")))
    fits = F.lit(False)
    for r in asked:
        fits = fits | role.contains(r)
    value = base * F.when(fits, 2.0).otherwise(1.0) * F.when(F.col("content_type").isin(preferred), 1.5).otherwise(1.0)
    return chunks.withColumn("score", F.greatest(F.lit(0.01), value * F.greatest("weight", F.lit(0.01))))


def top(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best by score (to nine digits), then keys; if no score is above 0.01 all are equal, and keys alone decide."""
    return scored.orderBy(F.desc(F.round("score", 9)), *keys).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# How many items a question gets, and what a failed scope is told.
STRICT, RELAXED = 15, 24
NO_SCOPE = "authorized paper scope is unavailable"


def _asked_roles(question: Column) -> Column:
    """The section roles that a question asks for."""
    low = F.lower(question)
    some = [(role, [F.contains(low, F.lit(w)) for w in words]) for role, words in X.QUESTION_ROLES.items()]
    each = []
    for role, found in some:
        hit = found[0]
        for f in found[1:]:
            hit = hit | f
        each.append(F.when(hit, F.lit(role)))
    return F.array_compact(F.array(*each))


def authorised_scopes(requests: DataFrame, papers: DataFrame) -> DataFrame:
    """request_id, paper_id, version: of requests all of whose papers are the user's, ready and not deleted."""
    wanted = requests.select("request_id", "user_id", F.explode(F.array_distinct("paper_ids")).alias("paper_id"))
    own = papers.filter("status = 'ready' AND deleted_at IS NULL").select("paper_id", F.col("owner_id").alias("user_id"), "version")
    held = wanted.join(own, ["paper_id", "user_id"])
    whole = held.groupBy("request_id").agg(F.count("*").alias("_held")).join(requests.select("request_id", F.size(F.array_distinct("paper_ids")).alias("_wanted")), "request_id").filter("_held = _wanted")
    return held.join(whole.select("request_id"), "request_id").select("request_id", "paper_id", "version")


def retrieve(requests: DataFrame, papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """request_id, rank, paper_id, chunk_id, page, score, uri: what each request is given.

    ``requests``: request_id, user_id, paper_ids, question, relaxed, preferred (content types). ``papers``: paper_id,
    owner_id, status, deleted_at, version. ``chunks``: paper_id, version, chunk_id, page, content, section_role,
    content_type, weight, indexable. Only indexable chunks of a paper's current version count. The best STRICT (or
    RELAXED) by score go, then by paper, page and chunk; where nothing matches, the first by page and chunk.

    A request meets the chunks of its own papers only, in one join on the paper and version; ranks are cut
    before rows meet."""
    terms = requests.select("request_id", X.question_terms(F.col("question")).alias("_terms"), _asked_roles(F.col("question")).alias("_roles"), "preferred", F.when(F.col("relaxed"), RELAXED).otherwise(STRICT).alias("_most"))
    scopes = authorised_scopes(requests, papers).filter("version IS NOT NULL").join(terms, "request_id")
    met = scopes.join(chunks.filter("indexable"), ["paper_id", "version"])
    role = F.lower(F.coalesce("section_role", F.lit("")))
    fits = F.exists("_roles", lambda r: F.contains(role, r))
    value = X.relevance(F.col("content"), F.col("_terms")) * F.when(fits, 2.0).otherwise(1.0) * F.when(F.array_contains(F.coalesce("preferred", F.array().cast("array<string>")), F.col("content_type")), 1.5).otherwise(1.0)
    scored = met.withColumn("score", F.greatest(F.lit(0.01), value * F.greatest("weight", F.lit(0.01))))
    of_request = Window.partitionBy("request_id")
    # whether anything matched is known from the best row, so no second pass over the scores is needed
    by_score = F.row_number().over(of_request.orderBy(F.desc(F.round("score", 9)), "paper_id", "page", "chunk_id"))
    by_page = F.row_number().over(of_request.orderBy("page", "chunk_id"))
    ranked = scored.withColumn("_best", F.max("score").over(of_request)).withColumn("rank", F.when(F.col("_best") > 0.01, by_score).otherwise(by_page))
    uri = F.concat(F.lit("paper://"), F.col("paper_id").cast("string"), F.lit("/"), F.col("chunk_id").cast("string"))
    return ranked.filter(F.col("rank") <= F.col("_most")).select("request_id", "rank", "paper_id", "chunk_id", "page", "score", uri.alias("uri"))


def outcomes(requests: DataFrame, papers: DataFrame, items: DataFrame) -> DataFrame:
    """request_id, relaxed, n_items, paper_summary (of its papers in order, those that have one), warnings: one row a
    request, also where it is given nothing. A request for no paper has no scope to fail."""
    scope = authorised_scopes(requests, papers).join(papers.select("paper_id", "summary"), "paper_id")
    parts = F.array_sort(F.collect_list(F.struct("paper_id", F.coalesce("summary", F.lit("")).alias("summary"))))
    told = scope.groupBy("request_id").agg(F.array_join(F.filter(F.transform(parts, lambda p: p["summary"]), lambda s: s != ""), "\n\n").alias("paper_summary"))
    n = items.groupBy("request_id").agg(F.count("*").alias("n_items"))
    both = requests.select("request_id", "relaxed", (F.coalesce(F.size("paper_ids"), F.lit(0)) > 0).alias("_asks")).join(told, "request_id", "left").join(n, "request_id", "left")
    none = F.array().cast("array<string>")
    return both.select("request_id", "relaxed", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("paper_summary", F.lit("")).alias("paper_summary"), F.when(F.col("_asks") & F.col("paper_summary").isNull(), F.array(F.lit(NO_SCOPE))).otherwise(none).alias("warnings"))
