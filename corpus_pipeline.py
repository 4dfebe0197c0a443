"""Corpus pipeline: the stages, in order, that turn `documents` into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import decontaminate, jaccard_join, langid, packing, suffix_dedup
from quirework.llm.common import Stage, fold, ship, table

PASSAGE = 240

Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the classifier rejects: no letter, or no clear winner."""
    ship(spark)
    model = langid.fit(docs.filter(fold(5) != 0).select("doc_id", "text", F.col("lang").alias("label")))
    found = langid.predict(docs, model, [F.col(c) for c in docs.columns])
    return found.filter(~F.col("rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of least doc_id, of each group of near duplicates."""
    ship(spark)
    return jaccard_join.keep_one(docs)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts from texts all bytes inside stretches of PASSAGE bytes that also stand earlier, so the first
    copy of a passage stays. 240 bytes are fewer than 51 words of running text take."""
    ship(spark)
    return suffix_dedup.dedup(docs, length=PASSAGE, keep_first=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what is left into sequences of powers of two."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Step]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_bytes", repeated_bytes),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Models and greedy cuts are beyond SQL; tests/llm holds the operators behind the stages against brute
#: force (near duplicates, repeated bytes, BM25 search, packing) or held-out rows (language), and runs all
#: stages once. Null and empty texts pass repeated_bytes and decontamination as they are; language_id drops
#: them, as they have no letter. Rows equal in all columns are copies of each other: near_duplicates keeps
#: one. An empty table gives an empty one at each stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to `documents`; what a stage returns is written and read before the next."""
    docs = table(spark, sf_dir, "documents")
    done: Stage | None = None
    for name, step in STAGES:
        stage = Stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if done:
            done.drop()
        done, docs = stage, stage.df
    return docs
