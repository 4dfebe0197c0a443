"""Matching of text spans to parsed blocks of a page, by what their texts share or by where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from .relational import settled
from .sequences import gram_pairs
from .spatial import touching

# The limits and scores that results depend on.
SHORTEST, SAME_PLACE, SHARED, SHARE = 8, 0.8, 3, 0.8
TOKEN = r"[a-z0-9]{3,}"


def match_key(text: Column) -> Column:
    """A text without white space, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))


def matching_spans(blocks: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block_id, span_id, score, rank: for each block the spans that match it, best first, then by span_id.

    ``blocks``: keys, block_id, text, box (or null). ``spans``: keys, span_id, text, box. A text that holds the other
    (of SHORTEST characters at least) scores 100 and up to 50 for the shorter one's length; texts that share SHARED
    tokens or more, SHARE of the smaller set, 70 and up to 20 for the share; boxes that lie alike 90 and up to 9.

    Pairs are found by what they need to have in common: the shorter text's first eight characters, tokens, or a
    cell of the page's grid. Each way is a join on that and the page, so no page meets itself whole."""
    b = blocks.select(*keys, "block_id", match_key(F.col("text")).alias("block_key"), F.col("box").alias("block_box"))
    s = spans.select(*keys, "span_id", match_key(F.col("text")).alias("span_key"), F.col("box").alias("span_box"))
    held = gram_pairs(b, s, keys, ("block_id", "block_key"), ("span_id", "span_key"))
    both = held.join(b.select(*keys, "block_id", "block_key"), [*keys, "block_id"]).join(s.select(*keys, "span_id", "span_key"), [*keys, "span_id"])
    shorter = F.least(F.length("block_key"), F.length("span_key"))
    contained = both.filter((shorter >= SHORTEST) & (F.contains("block_key", "span_key") | F.contains("span_key", "block_key"))).select(*keys, "block_id", "span_id", (100 + F.least(shorter, F.lit(50))).alias("score"))
    tokens = lambda df, own, key: df.select(*keys, own, F.array_distinct(F.regexp_extract_all(key, F.lit(TOKEN), F.lit(0))).alias("_t")).select(*keys, own, F.size("_t").alias(f"_n_{own}"), F.explode("_t").alias("_token"))
    shared = tokens(b, "block_id", "block_key").join(tokens(s, "span_id", "span_key"), [*keys, "_token"]).groupBy(*keys, "block_id", "span_id", "_n_block_id", "_n_span_id").agg(F.count("*").alias("_m"))
    share = F.col("_m") / F.least("_n_block_id", "_n_span_id")
    worded = shared.filter((F.col("_m") >= SHARED) & (share >= SHARE)).select(*keys, "block_id", "span_id", (70 + F.floor(share * 20)).cast("int").alias("score"))
    overlap = G.iou(F.col("block_box"), F.col("span_box"))
    near = touching(b.select(*keys, "block_id", "block_box"), s.select(*keys, "span_id", "span_box"), keys, "block_box", "span_box").withColumn("_iou", overlap)
    placed = near.filter(F.col("_iou") >= SAME_PLACE).select(*keys, "block_id", "span_id", (90 + F.floor(F.col("_iou") * 9)).cast("int").alias("score"))
    # a text that is held decides over shared tokens, though their score could not pass it anyway
    best = contained.unionByName(worded).unionByName(placed).groupBy(*keys, "block_id", "span_id").agg(F.max("score").cast("int").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "block_id").orderBy(F.desc("score"), "span_id")))


def page_matching_spans(pages: DataFrame, keys: list[str]) -> DataFrame:
    """As ``matching_spans``, for pages whose few ``blocks`` (block_id, text, box) and ``spans`` (span_id, text, box) come
    as arrays of a row: all pairs of a page are looked at where they are, and nothing travels."""

    def parts(column: str) -> Column:
        keyed = F.transform(column, lambda x: F.struct(x[f"{column[:-1]}_id"].alias("id"), match_key(x["text"]).alias("key"), x["box"].alias("box")))
        return F.transform(keyed, lambda x: F.struct(x["id"].alias("id"), x["key"].alias("key"), F.array_distinct(F.regexp_extract_all(x["key"], F.lit(TOKEN), F.lit(0))).alias("tokens"), x["box"].alias("box")))

    pairs = settled(pages.select(*keys, "blocks", "spans"), _b=parts("blocks"), _s=parts("spans"))
    pairs = pairs.select(*keys, F.explode("_b").alias("b"), "_s").select(*keys, "b", F.explode("_s").alias("s"))
    shorter = F.least(F.length("b.key"), F.length("s.key"))
    contained = (shorter >= SHORTEST) & (F.contains("b.key", "s.key") | F.contains("s.key", "b.key"))
    few = F.least(F.size("b.tokens"), F.size("s.tokens"))
    share = F.when(few >= SHARED, F.size(F.array_intersect("b.tokens", "s.tokens"))) / few
    worded = (share * few >= SHARED) & (share >= SHARE)
    by_text = F.when(contained, 100 + F.least(shorter, F.lit(50))).when(worded, (70 + F.floor(share * 20)).cast("int")).otherwise(0)
    overlap = G.iou(F.col("b.box"), F.col("s.box"))
    placed = F.when(overlap >= SAME_PLACE, (90 + F.floor(overlap * 9)).cast("int")).otherwise(0)
    best = pairs.select(*keys, F.col("b.id").alias("block_id"), F.col("s.id").alias("span_id"), F.greatest(by_text, placed).cast("int").alias("score")).filter("score > 0")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "block_id").orderBy(F.desc("score"), "span_id")))
