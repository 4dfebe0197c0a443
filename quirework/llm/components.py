"""Connected components by alternating large-star and small-star rounds.

Every round is an aggregate and a join on node ids; a node's neighbours are never gathered in one
row, and edges stay in tables in the shared folder. The number of rounds grows with the logarithm
of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def _towards_least(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least node in the node's neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node's smaller neighbours, and the node, to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, label: str) -> Stage:
    """``edges``: long columns a, b. Returns node, root (the least node of its component)."""
    now = Stage(_tidy(edges), f"{label}-edges")

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    was = state(now.df)
    while was[0]:
        then = Stage(_tidy(_small_star(_tidy(_towards_least(now.df)))), f"{label}-edges")
        now.drop()
        now, is_ = then, state(then.df)
        if is_ == was:
            break
        was = is_
    roots = now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = Stage(roots.union(now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), f"{label}-roots")
    now.drop()
    return out
