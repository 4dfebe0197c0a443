"""Queries over whole tables, one for each operator; ``ORACLES`` holds SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, filter_audit, jaccard_join, langid, lexical_search, line_dedup, lm, packing, quality, substring_dedup, suffix_dedup, toxicity
from .common import fold, table
from .labelled import labelled_sample


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(labelled_sample(docs, labels, "quality"))
    found = quality.score(docs, model, [F.col("doc_id"), (fold(5) == 0).alias("held_out")])
    return found.select("row.doc_id", "row.held_out", "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.fit(labelled_sample(docs, labels, "toxic"))
    found = toxicity.score(docs, field, [F.col("doc_id"), (fold(5) == 0).alias("held_out")])
    return found.select("row.doc_id", "row.held_out", "score", "predicted", "spans")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold(5) != 0).select("doc_id", "text", F.col("lang").alias("label")))
    found = langid.predict(docs, model, [F.col("doc_id"), (fold(5) == 0).alias("held_out")])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_packing": op6_packing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_line_dedup": op12_line_dedup,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

ORACLES: dict[str, str] = {
    "op11_filter_interaction_audit": filter_audit.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_ranked_lexical_search": lexical_search.ORACLE,
}
