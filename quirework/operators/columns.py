"""Column and body geometry of documents from the edges of their text lines.

``lines``: keys of a document, page, line_id (their order), native_id, text, x0, y0, x1, y1, baseline, size, font,
width and height (of the page). Every statistic is a grouped count or median by document and bin; no
document is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

# The limits that results depend on.
LEAST_KEY = 20
BODY_SIZES, BIN, NEAR_SIZE = (7.5, 12.5), 2.0, 0.55
LEFT, RIGHT, LEAST_LINES = 0.45, 0.50, 5
ONE_COLUMN_SIZES, FIRST_TOP, TOP_LIMIT, TOP_BIN = (9.25, 10.75), 45.0, 100.0, 1.5
GAPS = (5.0, 30.0)


def _binned(lines: DataFrame, keys: list[str], entries: list[Column]) -> DataFrame:
    """keys, kind, bin, name, and what a line's ``entries`` of these come to: n, sd, middle, least, weight, at. Lines
    are read once for all kinds of statistics."""
    each = lines.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*").filter("value IS NOT NULL")
    return each.groupBy(*keys, "kind", "bin", "name").agg(F.count("*").alias("n"), F.round(F.stddev_pop("value"), 9).alias("sd"), F.median("value").alias("middle"), F.min("value").alias("least"), F.sum("weight").alias("weight"), F.min("at").alias("at"))


def _entry(kind: str, value: Column, bin_: Column | None = None, name: Column | None = None, weight: Column | None = None, at: bool = False) -> Column:
    where = F.struct(F.col("page").cast("long").alias("page"), F.col("line_id").cast("long").alias("line_id"))
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"), value.cast("double").alias("value"), (none if bin_ is None else bin_).cast("double").alias("bin"), (none if name is None else name).cast("string").alias("name"),
        (none if weight is None else weight).cast("long").alias("weight"), (where if at else none.cast("struct<page:bigint,line_id:bigint>")).alias("at"))


def _edge(kind: str, value: Column) -> Column:
    return _entry(kind, value, F.bround(value / BIN))


def _mode(kind: str) -> Column:
    """Median of the kind's fullest bin; less spread, then the lower bin wins."""
    return F.min_by(F.when(F.col("kind") == kind, F.col("middle")), F.when(F.col("kind") == kind, F.struct(-F.col("n"), F.col("sd"), F.col("bin"))))


def column_geometry(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row a document that has body lines: its columns, with widths by the rule of equal columns.

    ``body_end``, the last page of the body, is a column of ``lines``; null sets no end. Body lines are long
    enough, inside the margins and of the commonest size by characters (the first on a tie)."""
    w, h = F.col("width"), F.col("height")
    inside = (F.col("x0") >= w * 0.07) & (F.col("x1") <= w * 0.96) & (F.col("y0") >= h * 0.06) & (F.col("y1") <= h * 0.93)
    in_body = F.col("body_end").isNull() | (F.col("page") <= F.greatest("body_end", F.lit(1)))
    fit = lines.filter(in_body & inside & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & F.col("size").between(*BODY_SIZES))
    fit = fit.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).withColumn("_key", X.letters_key(F.col("text"))).filter(F.length("_key") >= LEAST_KEY)
    fit = fit.select(*keys, "page", "line_id", "x0", "x1", "size", "width", F.length("text").alias("_n"), (F.bround(F.col("size") * 2) / 2).alias("_half")).repartition(*keys)
    # windows in place of joins with the document's own statistics: its lines are laid out and keyed once
    of_doc, of_size = Window.partitionBy(*keys), Window.partitionBy(*keys, "_half")
    sized = fit.withColumn("_w", F.sum("_n").over(of_size)).withColumn("_at", F.min(F.struct("page", "line_id")).over(of_size))
    main = sized.withColumn("body_size", F.min_by("_half", F.struct(-F.col("_w"), F.col("_at"))).over(of_doc))
    body = main.filter(F.abs(F.col("size") - F.col("body_size")) <= NEAR_SIZE).withColumn("_width", F.median("width").over(of_doc))
    sided = body.withColumn("_side", F.when(F.col("x0") < F.col("_width") * LEFT, "left").when(F.col("x0") > F.col("_width") * RIGHT, "right"))
    of = lambda side, c: F.when(F.col("_side") == side, F.col(c))
    edges = {"left_start": of("left", "x0"), "right_start": of("right", "x0"), "left_end": of("left", "x1"), "right_end": of("right", "x1")}
    bins = _binned(sided, [*keys, "body_size"], [*(_edge(n, c) for n, c in edges.items()), _entry("page", F.lit(1), F.col("page"))])
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    n = bins.groupBy(*keys, "body_size").agg(total("page").alias("lines"), F.count(F.when(F.col("kind") == "page", F.col("bin"))).alias("pages"), total("left_start").alias("_left"), total("right_start").alias("_right"), *(_mode(e).alias(e) for e in edges))
    two = (F.col("_left") >= LEAST_LINES) & (F.col("_right") >= LEAST_LINES)
    only = lambda c: F.when(two, c)
    width, pitch = F.col("right_end") - F.col("left_start"), F.col("right_start") - F.col("left_start")
    return n.select(
        *keys, F.when(two, 2).otherwise(1).alias("columns"), "body_size", "lines", "pages", *(only(F.col(c)).alias(c) for c in ("left_start", "left_end", "right_start", "right_end")),
        only(width).alias("text_width"), only(F.col("right_start") - F.col("left_end")).alias("ink_gap"), only(width - pitch).alias("column_width"), only(2 * pitch - width).alias("gutter"),
        F.when(two, F.least(F.lit(0.99), 0.75 + F.col("lines") / 1000)).otherwise(0.7).alias("confidence"),
    )


def body_geometry(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row a document that has body lines, as of a page of one column: edges, top, size, font and line pitch.

    ``references_at``, the page where references begin, is a column of ``lines``; null sets no end."""
    before = F.col("references_at").isNull() | (F.col("page") < F.col("references_at"))
    fit = lines.filter(before & (F.col("y0") >= FIRST_TOP) & F.col("size").between(*ONE_COLUMN_SIZES)).withColumn("_key", X.letters_key(F.col("text"))).filter(F.length("_key") >= LEAST_KEY)
    fit = fit.select(*keys, "page", "line_id", "native_id", "x0", "x1", "y0", "baseline", "size", "font", F.length("text").alias("_n")).repartition(*keys)
    # the next baseline of a native block, which lies on one page; the block is part of the window's key. Lines
    # without a baseline come first, so they are nobody's next
    gap = F.lead("baseline").over(Window.partitionBy(*keys, "page", "native_id").orderBy("baseline")) - F.col("baseline")
    gapped = fit.withColumn("gap", gap)
    n = F.col("_n")
    top = F.when(F.col("y0") < TOP_LIMIT, F.col("y0"))
    bins = _binned(gapped, keys, [
        _edge("left", F.col("x0")), _edge("right", F.col("x1")), _entry("page", F.lit(1), F.col("page")), _entry("top", top, F.col("page")), _entry("size", F.col("size"), F.col("size"), weight=F.greatest(n, F.lit(1))),
        _entry("font", F.lit(1), name=F.col("font"), weight=n, at=True), _entry("gap", F.when(F.col("gap").between(*GAPS), F.col("gap")))])
    run = Window.partitionBy(*keys, "kind").orderBy("bin")
    summed = bins.withColumn("_run", F.sum("weight").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("weight").over(Window.partitionBy(*keys, "kind")))
    # tops of pages are binned in their turn; of all else a group is one row
    is_ = lambda kind: F.col("kind") == kind
    again = summed.groupBy(*keys, "kind", F.when(is_("top"), F.bround(F.col("least") / TOP_BIN)).otherwise(F.col("bin")).alias("bin"), "name").agg(
        F.when(is_("top"), F.count("*")).otherwise(F.max("n")).alias("n"), F.when(is_("top"), F.round(F.stddev_pop("least"), 9)).otherwise(F.max("sd")).alias("sd"), F.when(is_("top"), F.median("least")).otherwise(F.max("middle")).alias("middle"),
        F.max("weight").alias("weight"), F.min("at").alias("at"), F.bool_or(F.col("_run") * 2 >= F.col("_all")).alias("half"))
    of = lambda kind, c: F.when(is_(kind), c)
    found = again.groupBy(*keys).agg(
        F.sum(of("page", F.col("n"))).alias("lines"), F.count(of("page", F.col("bin"))).alias("pages"), _mode("left").alias("left"), _mode("right").alias("right"), _mode("top").alias("top"), F.min(of("size", F.when(F.col("half"), F.col("bin")))).alias("size"),
        F.min_by(of("font", F.col("name")), of("font", F.struct(-F.col("weight"), F.col("at")))).alias("font"), F.max(of("gap", F.col("middle"))).alias("line_gap"))
    # a document without a key is nobody's: it has counts alone, as where statistics are joined by key
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    only = lambda c: F.when(named, F.col(c)).alias(c)
    return found.select(*keys, "lines", "pages", only("left"), only("right"), F.when(named, F.col("right") - F.col("left")).alias("width"), *(only(c) for c in ("top", "size", "font", "line_gap")))
