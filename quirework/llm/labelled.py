"""A bounded, evenly chosen set of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

SAMPLE = 8000
FOLDS = 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, salt: str = "sample") -> DataFrame:
    """text, label of at most ``sample`` rows whose fold is not 0, least hash of the id first.

    The chosen labels are at most ``sample`` narrow rows, so they are broadcast to the documents. Where ids repeat,
    in either table, more rows than that meet; the bound is applied to them again, least hash of id and text first.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    usable = usable.filter(fold(FOLDS) != 0)
    chosen = usable.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id", "label").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = text.join(F.broadcast(chosen), "doc_id")
    return met.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id", F.xxhash64("text"), "label").limit(sample).select("text", "label")
