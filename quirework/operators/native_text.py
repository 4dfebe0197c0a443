"""Role-tagged blocks from the lines of a native text layer, in the order of the content stream.

The rules walk the lines and remember an open heading; here that memory is a window: a large line belongs to a
heading if the last numbered prefix of its raw block comes after the block's last small line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Words, patterns and limits that results depend on.
HEADING_WORDS = ["abstract", "references", "bibliography", "acknowledgments", "acknowledgements"]
REFERENCE_SECTIONS = ["references", "bibliography"]
PREFIX, NUMBERED = r"^\d+(?:\.\d+)*\.?$", r"^\d+(?:\.\d+)*\.?\s+\S"
LARGER, TITLE_LARGER, TITLE_LENGTH, HEADING_LENGTH = 0.5, 4.0, 240, 160


def with_body_size(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with ``body_size``: the size, to a tenth, of most characters of the document; the first on a tie.
    Windows, so that lines are read once and not met with a statistic of their own."""
    of_size = Window.partitionBy(*keys, "_tenth")
    sized = lines.withColumn("_tenth", F.bround("max_size", 1)).withColumn("_w", F.sum(F.length("text")).over(of_size)).withColumn("_at", F.min("position").over(of_size))
    return sized.withColumn("body_size", F.min_by("_tenth", F.struct(-F.col("_w"), F.col("_at"))).over(Window.partitionBy(*keys))).drop("_tenth", "_w", "_at")


def _line_role(text: Column) -> Column:
    title = (F.col("page") == 1) & (F.col("max_size") >= F.col("body_size") + TITLE_LARGER) & (F.length(text) <= TITLE_LENGTH)
    named = F.lower(F.regexp_replace(text, ":+$", "")).isin(HEADING_WORDS)
    numbered = (F.length(text) <= HEADING_LENGTH) & (F.col("max_size") >= F.col("body_size") + LARGER) & text.rlike(NUMBERED)
    return F.when(title, "title").when(named | numbered, "heading").otherwise("paragraph")


def tagged_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines``: keys, position (in the stream), page, raw_block, text, box, max_size. Lines without text are left out.

    One row a block, in order: block (from 1), page, role (title, heading, paragraph, reference_entry), section,
    content_type, text, box, lines. A title has no section and doesn't change the one it stands in."""
    given = lines.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).withColumn("text", F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))).filter("text != ''")
    sized = with_body_size(given, keys)
    big = F.col("max_size") >= F.col("body_size") + LARGER
    raw = Window.partitionBy(*keys, "page", "raw_block").orderBy("position")
    so_far = raw.rowsBetween(Window.unboundedPreceding, 0)
    begins = big & F.col("text").rlike(PREFIX)
    seen = sized.withColumn("_begins", begins).withColumn("_begun", F.max(F.when(F.col("_begins"), F.col("position"))).over(so_far)).withColumn("_small", F.max(F.when(~big, F.col("position"))).over(so_far))
    member = F.coalesce(F.col("_begun") > F.coalesce("_small", F.lit(-1)), F.lit(False))
    role = F.when(member, "heading").otherwise(_line_role(F.col("text")))
    seen = seen.withColumn("_member", member).withColumn("role", role)
    before_member, before_role = F.lag("_member").over(raw), F.lag("role").over(raw)
    # a block goes on with the next part of a begun heading, or with the next paragraph line
    goes_on = F.when(F.col("_member"), ~F.col("_begins")).otherwise((F.col("role") == "paragraph") & (before_role == "paragraph") & ~before_member)
    of_doc = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    cut = seen.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("block", F.sum("_new").over(of_doc))
    edge = lambda f, c: f(F.col(f"box.{c}"))
    box = F.struct(edge(F.min, "x0").alias("x0"), edge(F.min, "y0").alias("y0"), edge(F.max, "x1").alias("x1"), edge(F.max, "y1").alias("y1"))
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    blocks = cut.groupBy(*keys, "block").agg(F.min("page").alias("page"), F.min("role").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), box.alias("box"), F.count("*").alias("lines"))
    heading = F.last(F.when(F.col("role") == "heading", F.col("text")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    placed = blocks.withColumn("section", F.when(F.col("role") == "title", "").otherwise(F.coalesce(heading, F.lit(""))))
    final = F.when((F.col("role") == "paragraph") & F.lower(F.trim("section")).isin(REFERENCE_SECTIONS), "reference_entry").otherwise(F.col("role"))
    kind = F.when(F.col("role") == "reference_entry", "reference").when(F.col("role").isin("title", "heading"), "metadata").otherwise("text")
    return placed.withColumn("role", final).select(*keys, "block", "page", "role", "section", kind.alias("content_type"), "text", "box", "lines")
