"""Matching of one text to a run of consecutive lines, as a parser joins lines that the page holds apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.udfs import matching_ratio
from .relational import settled

GRAM = 8
CHUNK = 256
HEADS = 256
STRIDE = 64


def _grams(df: DataFrame, keys: list[str], own: str, text: str) -> DataFrame:
    """``own`` with each run of GRAM characters of its text, some of them twice (pairs are made distinct later). Long texts are cut into overlapping chunks first, as
    a substring costs its distance from the start."""
    n = F.length(text)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - GRAM, F.lit(0)) / CHUNK).cast("int")), lambda k: F.substring(F.col(text), k * CHUNK + 1, F.lit(CHUNK + GRAM - 1)))
    parts = df.filter(n >= GRAM).select(*keys, own, F.explode(chunks).alias("_chunk"))
    each = F.transform(F.sequence(F.lit(1), F.length("_chunk") - GRAM + 1), lambda i: F.substring(F.col("_chunk"), i, F.lit(GRAM)))
    return parts.filter(F.length("_chunk") >= GRAM).select(*keys, own, F.explode(F.array_distinct(each)).alias("_gram"))


def holding(heads: DataFrame, texts: DataFrame, keys: list[str], own: str, text: str) -> DataFrame:
    """The rows of ``heads`` (``keys``, an id, _gram of GRAM characters) beside each ``own`` of ``texts`` whose text holds
    the gram, all without texts.

    A page's heads travel to its texts as one row, and no text is taken apart. Only where a page has more than
    HEADS heads its texts' grams are made and joined instead, so that such a page doesn't compare all with all."""
    theirs = [c for c in heads.columns if c not in keys]
    counted = heads.groupBy(*keys).agg(F.count("*").alias("_heads"))
    crowded = counted.filter(F.col("_heads") > HEADS).select(*keys)
    few = heads.join(crowded, keys, "left_anti").groupBy(*keys).agg(F.collect_list(F.struct(*theirs)).alias("_all"))
    met = texts.select(*keys, own, text).join(few, keys).select(*keys, own, F.explode(F.filter("_all", lambda h: F.contains(F.col(text), h["_gram"]))).alias("_head"))
    near = met.select(*keys, own, *(F.col(f"_head.{c}").alias(c) for c in theirs))
    many = heads.join(crowded, keys, "left_semi").join(_grams(texts.join(crowded, keys, "left_semi"), keys, own, text), [*keys, "_gram"])
    return near.drop("_gram").unionByName(many.drop("_gram"))


def gram_pairs(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """keys and ids of pairs where one text may hold the other: the first GRAM characters of either are a run of
    characters of the other. ``a`` and ``b``: names of id and text. Texts shorter than GRAM meet nothing."""

    def head(df: DataFrame, own: str, text: str) -> DataFrame:
        return df.filter(F.length(text) >= GRAM).select(*keys, own, F.substring(text, 1, GRAM).alias("_gram"))

    one = holding(head(left, *a), right, keys, *b)
    other = holding(head(right, *b), left, keys, *a)
    return one.select(*keys, a[0], b[0]).union(other.select(*keys, a[0], b[0])).distinct()


def starts(blocks: DataFrame, lines: DataFrame, keys: list[str], head: int, least: int) -> DataFrame:
    """keys, block_id, at: lines of at least ``least`` characters that hold the first ``head`` characters of the
    block's key, or whose own first ones it holds.

    They meet at a common run of GRAM characters; only heads shorter than that meet their whole page."""
    first = lambda c: F.substring(F.col(c), 1, head)
    b = blocks.select(*keys, "block_id", F.col("key").alias("block_key"), first("key").alias("prefix"))
    ls = lines.filter(F.length("key") >= least).select(*keys, "at", F.col("key").alias("line_key"), first("key").alias("line_head"))
    fits = F.contains("line_key", "prefix") | F.contains("block_key", "line_head")
    long_, short = (lambda c: F.length(c) >= GRAM), (lambda c: F.length(c) < GRAM)
    by_prefix = holding(b.filter(long_("prefix")).select(*keys, "block_id", F.substring("prefix", 1, GRAM).alias("_gram")), ls, keys, "at", "line_key")
    by_head = holding(ls.filter(long_("line_head")).select(*keys, "at", F.substring("line_head", 1, GRAM).alias("_gram")), b, keys, "block_id", "block_key")
    near = by_prefix.select(*keys, "block_id", "at").union(by_head.select(*keys, "block_id", "at")).distinct()
    held = near.join(b, [*keys, "block_id"]).join(ls, [*keys, "at"]).filter(fits)
    brief = b.filter(short("prefix")).join(ls, keys).filter(fits).select(*keys, "block_id", "at")
    few = b.filter(long_("prefix")).join(ls.filter(short("line_head")), keys).filter(fits).select(*keys, "block_id", "at")
    return held.select(*keys, "block_id", "at").union(brief).union(few).distinct()


def windows(blocks: DataFrame, lines: DataFrame, keys: list[str], head: int, least: int, most: int, low: Callable[[Column], Column], high: Callable[[Column], Column]) -> DataFrame:
    """keys, block_id, key, at, n, joined: each run of up to ``most`` lines from a start whose length is from
    ``low`` to ``high`` of the block's. Lengths decide before any text is joined."""
    # a line travels with its own stretch of the page and the one before, not with every line it may follow
    stride = max(STRIDE, most)
    at = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1) / stride)
    dealt = lines.select(*keys, "at", "key", at.alias("_own")).withColumn("_stretch", F.explode(F.array(F.col("_own"), F.col("_own") - 1)))
    inner = F.when(F.col("_own") == F.col("_stretch"), F.col("at"))
    runs = dealt.groupBy(*keys, "_stretch").agg(F.array_sort(F.collect_list(F.struct("at", F.col("key").alias("line_key")))).alias("_lines"), F.min(inner).alias("_from"), F.max(inner).alias("_to")).filter("_from IS NOT NULL")
    found = starts(blocks, lines, keys, head, least).join(blocks.select(*keys, "block_id", "key"), [*keys, "block_id"]).join(runs, keys).filter("at BETWEEN _from AND _to")
    follow = F.slice(F.filter("_lines", lambda x: x["at"] >= F.col("at")), F.lit(1), F.lit(most))
    found = found.select(*keys, "block_id", "key", "at", F.transform(follow, lambda x: x["line_key"]).alias("texts"))
    sizes = F.transform("texts", lambda t: F.length(t))
    found = settled(found, _sizes=sizes, _n=F.length("key"))
    sums = F.transform(F.sequence(F.lit(1), F.size("_sizes")), lambda k: F.struct(k.alias("n"), F.aggregate(F.slice("_sizes", F.lit(1), k), F.lit(0), lambda a, x: a + x).alias("size")))
    kept = F.filter(sums, lambda s: (s["size"] >= low(F.col("_n"))) & (s["size"] <= high(F.col("_n"))))
    each = found.withColumn("_w", F.explode(kept))
    return each.select(*keys, "block_id", "key", "at", F.col("_w.n").alias("n"), F.array_join(F.slice("texts", F.lit(1), F.col("_w.n")), "").alias("joined"))


def _best(scored: DataFrame, keys: list[str]) -> DataFrame:
    best = F.min_by(F.struct("at", "n", "score"), F.struct(-F.col("score"), F.col("at"), F.col("n")))
    return scored.groupBy(*keys, "block_id").agg(best.alias("b")).select(*keys, "block_id", F.col("b.at").alias("first_line"), F.col("b.n").alias("lines"), F.col("b.score").alias("score"))


def similar_runs(blocks: DataFrame, lines: DataFrame, keys: list[str], most: int = 45, least_score: float = 0.78) -> DataFrame:
    """first_line, lines, score: of each block (keys, block_id, key) the run of lines (keys, at: their order on the
    page, key) of most similar text, the first on a tie; none below ``least_score``.

    A ratio is worked out only where lengths allow more than what containment gives the block anywhere, or as
    much; where that is 1, no other run reaches it."""
    own = blocks.filter(F.length("key") >= 2)
    found = windows(own, lines, keys, 10, 0, most, lambda n: F.greatest(F.lit(2), F.floor(n / 6)), lambda n: n * 1.18 + 24)
    a, b = F.length("key"), F.length("joined")
    holds = F.contains("key", "joined") | F.contains("joined", "key")
    # a text that the other holds matches as a whole, so its ratio is the bound, which passes the length ratio
    bound = 2 * F.least(a, b) / (a + b)
    found = settled(found, share=F.when(holds, bound).otherwise(0.0), bound=bound).filter(F.greatest("share", "bound") >= least_score)
    found = found.withColumn("most", F.max("share").over(Window.partitionBy(*keys, "block_id")))
    asked = (F.col("bound") >= F.greatest("most", F.lit(least_score))) & (F.col("most") < 1)
    score = F.greatest("share", F.coalesce(matching_ratio(F.when(asked, F.col("key")), F.when(asked, F.col("joined")), least_score), F.lit(0.0)))
    kept = found.filter((F.col("share") == F.col("most")) | asked).withColumn("score", score).filter(F.col("score") >= least_score)
    return _best(kept, keys).withColumn("score", F.round("score", 4))


def holding_runs(blocks: DataFrame, lines: DataFrame, keys: list[str], most: int = 60) -> DataFrame:
    """As ``similar_runs``, but the block's text must hold the run's or the other way round; ``score`` is the
    difference in length, negative."""
    own = blocks.filter(F.length("key") >= 3)
    found = windows(own, lines, keys, GRAM, GRAM, most, lambda n: F.greatest(F.lit(3), F.floor(n / 5)), lambda n: n * 1.25 + 12)
    held = found.filter(F.contains("key", "joined") | F.contains("joined", "key"))
    return _best(held.withColumn("score", -F.abs(F.length("key") - F.length("joined")).cast("long")), keys)


def _page_windows(pages: DataFrame, keys: list[str], shortest: int, head: int, least: int, most: int, low: Callable[[Column], Column], high: Callable[[Column], Column]) -> DataFrame:
    """keys, block_id, key, _whole (the page's lines as one text) and _windows (at, n, start in that text, size): as ``windows``
    finds them, a row a block, for pages whose few ``blocks`` (block_id, key) and ``lines`` (at, key) come as arrays."""
    ends = F.aggregate("lines", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["key"]))))
    rows = settled(pages.filter(F.size("lines") > 0).select(*keys, "blocks", "lines"), _ends=ends, _whole=F.array_join(F.transform("lines", lambda x: x["key"]), ""))
    rows = rows.select(*keys, F.explode("blocks").alias("_b"), "lines", "_ends", "_whole").filter(F.length("_b.key") >= shortest)
    rows = settled(rows.select(*keys, "_b.block_id", "_b.key", "lines", "_ends", "_whole"), _n=F.length("key"), _prefix=F.substring("key", 1, head))
    fits = lambda x: (F.length(x["key"]) >= least) & (F.contains(x["key"], F.col("_prefix")) | F.contains(F.col("key"), F.substring(x["key"], 1, head)))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: fits(F.get("lines", i)))
    size = lambda i, n: F.get("_ends", i + n) - F.get("_ends", i)
    run = lambda i: F.sequence(F.lit(1), F.least(F.lit(most), F.size("lines") - i))
    each = lambda i: F.transform(F.filter(run(i), lambda n: size(i, n).between(low(F.col("_n")), high(F.col("_n")))), lambda n: F.struct(F.get("lines", i)["at"].alias("at"), n.alias("n"), (F.get("_ends", i) + 1).alias("start"), size(i, n).alias("size")))
    return settled(rows, _windows=F.flatten(F.transform(starts, each))).select(*keys, "block_id", "key", "_n", "_whole", "_windows")


def _joined(w: Column) -> Column:
    return F.substring(F.col("_whole"), w["start"], w["size"])


def _held(w: Column) -> Column:
    return F.contains(F.col("key"), _joined(w)) | F.contains(_joined(w), F.col("key"))


def page_similar_runs(pages: DataFrame, keys: list[str], most: int = 45, least_score: float = 0.78) -> DataFrame:
    """As ``similar_runs``, for pages whose few blocks and lines come as arrays of a row; only pairs that need the ratio
    leave the row with their texts, for Python."""
    found = _page_windows(pages, keys, 2, 10, 0, most, lambda n: F.greatest(F.lit(2), F.floor(n / 6)), lambda n: n * 1.18 + 24)
    # a text that the other holds matches as a whole, so its ratio is the bound, which passes the length ratio
    bound = lambda w: 2 * F.least(F.col("_n"), w["size"]) / (F.col("_n") + w["size"])
    near = F.filter("_windows", lambda w: bound(w) >= least_score)
    found = settled(found, _near=F.transform(near, lambda w: F.struct(w.alias("w"), bound(w).alias("bound"), F.when(_held(w), bound(w)).otherwise(0.0).alias("share"))))
    found = settled(found.drop("_windows"), _most=F.array_max(F.transform("_near", lambda x: x["share"])))
    asked = lambda x: (x["bound"] >= F.greatest("_most", F.lit(least_score))) & (F.col("_most") < 1)
    kept = found.select(*keys, "block_id", "key", "_whole", F.explode(F.transform(F.filter("_near", lambda x: (x["share"] == F.col("_most")) | asked(x)), lambda x: F.struct(x["w"].alias("w"), x["share"].alias("share"), asked(x).alias("asked")))).alias("_x"))
    some = F.when(F.col("_x.asked"), F.col("key")), F.when(F.col("_x.asked"), _joined(F.col("_x.w")))
    narrow = kept.select(*keys, "block_id", "_x.w.at", "_x.w.n", "_x.share", some[0].alias("_key"), some[1].alias("_joined"))
    score = F.greatest("share", F.coalesce(matching_ratio(F.col("_key"), F.col("_joined"), least_score), F.lit(0.0)))
    return _best(narrow.withColumn("score", score).filter(F.col("score") >= least_score), keys).withColumn("score", F.round("score", 4))


def page_holding_runs(pages: DataFrame, keys: list[str], most: int = 60) -> DataFrame:
    """As ``holding_runs``, for pages whose few blocks and lines come as arrays of a row."""
    found = _page_windows(pages, keys, 3, GRAM, GRAM, most, lambda n: F.greatest(F.lit(3), F.floor(n / 5)), lambda n: n * 1.25 + 12)
    best = F.array_min(F.transform(F.filter("_windows", _held), lambda w: F.struct(F.abs(F.col("_n") - w["size"]).alias("off"), w["at"].alias("at"), w["n"].alias("n"))))
    found = settled(found, _best=best).filter("_best IS NOT NULL")
    return found.select(*keys, "block_id", F.col("_best.at").alias("first_line"), F.col("_best.n").alias("lines"), (-F.col("_best.off")).cast("long").alias("score"))
