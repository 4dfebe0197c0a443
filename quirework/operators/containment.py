"""Which texts contain which needles, without comparing every text with every needle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing(texts: DataFrame, needles: DataFrame, text: str, needle: str) -> DataFrame:
    """Pairs where ``text`` contains ``needle``.

    A needle's longest inner word (bounded by blanks or line ends on both sides) is a word of every
    text that contains it, so texts' distinct words meet needles on that word and only these pairs are
    compared in full. Needles without an inner word are compared with every text; only they are."""
    words = F.filter(F.split(F.col(needle), r"[ \n]"), lambda w: w != "")
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<string>"))
    longest = F.get(F.array_sort(inner, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(0))
    keyed = needles.withColumn("_word", longest)
    held = texts.select("*", F.explode(F.array_distinct(F.split(text, r"[ \n]"))).alias("_word"))
    short = keyed.filter("_word is null").drop("_word")
    met = held.join(keyed.filter("_word is not null"), "_word").filter(F.contains(F.col(text), F.col(needle))).drop("_word")
    return met.unionByName(texts.join(short, F.contains(F.col(text), F.col(needle))))
