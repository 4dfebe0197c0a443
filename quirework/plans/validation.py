"""Checks of answers: cited evidence, numbers, and expected facts of golden cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def citation_errors(answers: DataFrame, claims: DataFrame, evidence: DataFrame, declared: DataFrame, score_ids: DataFrame) -> DataFrame:
    """answer_id, claim_id (null for the answer as a whole), error, ids (the offending ones, sorted).

    ``answers``: answer_id, route, refusal, scored. ``claims``: answer_id, claim_id, kind, evidence_id (a
    row a citation, null for a claim without any). ``evidence``: answer_id, evidence_id, source.
    ``declared`` and ``score_ids``: answer_id, evidence_id. All joins are on the answer and the id, so an
    answer's rows meet in one shuffle of each side and no list of ids grows beyond a claim.
    """
    key = ["answer_id", "evidence_id"]
    known = evidence.groupBy(*key).agg(F.min("source").alias("source"))
    named = declared.distinct().withColumn("declared", F.lit(True))
    standards = evidence.groupBy("answer_id").agg(F.bool_or(F.col("source") == "standard").alias("standards"))
    has = F.col("evidence_id").isNotNull()

    def unknown(rows: DataFrame, error: str) -> DataFrame:
        lost = rows.distinct().join(known, key, "left_anti").groupBy("answer_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("ids"))
        return lost.select("answer_id", F.lit(None).cast("long").alias("claim_id"), F.lit(error).alias("error"), "ids")

    cited = claims.join(known, key, "left").join(named, key, "left")
    per = cited.groupBy("answer_id", "claim_id", "kind").agg(
        F.array_sort(F.collect_set(F.when(has & F.col("source").isNull(), F.col("evidence_id")))).alias("ids"),
        F.count("evidence_id").alias("n"),
        F.coalesce(F.bool_or(F.col("source") == "paper"), F.lit(False)).alias("paper"),
        F.coalesce(F.bool_or(F.col("source") == "standard"), F.lit(False)).alias("standard"),
        F.bool_or(has & F.col("declared").isNull()).alias("omitted"),
    )
    per = per.join(answers.select("answer_id", "route"), "answer_id").join(standards, "answer_id", "left")
    positive = F.col("kind") == "positive"
    needs = (F.col("route") == "score") | ((F.col("route") == "review") & F.coalesce("standards", F.lit(False)))
    rest = F.array(
        F.when(positive & ~F.col("paper"), "claim_without_paper"),
        F.when(needs & ~F.col("standard"), "claim_without_standard"),
        F.when((F.col("n") > 0) & F.col("omitted"), "claim_beyond_declared"),
    )
    found = F.when(F.size("ids") > 0, F.array(F.lit("claim_cites_unknown"))).when(positive & (F.col("n") == 0), F.array(F.lit("claim_uncited"))).otherwise(F.array_compact(rest))
    of_claims = per.withColumn("error", F.explode(found)).select("answer_id", "claim_id", "error", F.when(F.col("error") == "claim_cites_unknown", F.col("ids")).otherwise(F.array().cast(per.schema["ids"].dataType)).alias("ids"))

    strange = score_ids.join(answers.filter("scored").select("answer_id"), "answer_id")
    lost = unknown(strange, "score_cites_unknown")
    wrong = strange.join(known.filter("source != 'standard'"), key).select("answer_id").distinct().join(lost, "answer_id", "left_anti")
    bare = answers.filter("route = 'score' AND NOT refusal AND NOT scored").select("answer_id")
    none = F.array().cast(per.schema["ids"].dataType)
    whole = [df.select("answer_id", F.lit(None).cast("long").alias("claim_id"), F.lit(e).alias("error"), none.alias("ids")) for df, e in ((wrong, "score_beyond_standards"), (bare, "score_missing"))]
    out = unknown(declared, "answer_declares_unknown").unionByName(of_claims).unionByName(lost)
    return out.unionByName(whole[0]).unionByName(whole[1])


def unsupported_numbers(text: Column, ids: Column, supported: Column, derived: Column) -> Column:
    """Numbers of a text, once evidence ids are out of it, that neither the evidence nor the score holds."""
    return F.array_sort(F.array_except(X.numbers_in(X.without_ids(text, ids)), F.concat(supported, derived)))


def golden_verdict(answer: Column, retrieved: Column, expected: Column, groups: Column, numbers: Column, forbidden: Column) -> Column:
    """Struct of citation_pass, missing_groups, missing_numbers, forbidden, answer_pass, status. A null
    answer is a case that was not run. Texts are compared without white space and case."""
    said = X.compact_key(F.coalesce(answer, F.lit("")))
    held = lambda x: F.contains(said, X.compact_key(x))
    cited = (F.size(expected) == 0) | F.arrays_overlap(expected, retrieved)
    lost_groups = F.size(F.filter(groups, lambda g: ~F.exists(g, held)))
    lost_numbers = F.filter(numbers, lambda n: ~held(n))
    shown = F.filter(forbidden, held)
    asserts = F.size(groups) + F.size(numbers) + F.size(forbidden) > 0
    passed = ~asserts | ((F.trim(F.coalesce(answer, F.lit(""))) != "") & (lost_groups == 0) & (F.size(lost_numbers) == 0) & (F.size(shown) == 0))
    status = F.when(answer.isNull(), "NOT_RUN").when(passed & cited, "PASS").otherwise("FAIL")
    run = answer.isNotNull()
    return F.struct((run & cited).alias("citation_pass"), lost_groups.cast("long").alias("missing_groups"), F.array_join(lost_numbers, ",").alias("missing_numbers"), F.array_join(shown, ",").alias("forbidden"), (run & passed).alias("answer_pass"), status.alias("status"))
