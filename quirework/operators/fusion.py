"""Fusion of semantic blocks with the native lines of a page: by place, by text, and by rules for conflicts.

A block's lines are those that lie in its box; they are checked against its text. Where text and place
disagree, or the box is missing or off the page, the native block of the most similar text stands in.
Blocks that stand for a figure or table take the box of the native object they cover.

All joins are on the page's key (a document and its page) and, within it, on grid cells or length classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions.udfs import keys_similarity, matching_ratios
from .relational import settled
from .spatial import touching

# The thresholds that results depend on.
MARGIN, LINE_SHARE, OBJECT_SHARE = 3.0, 0.45, 0.35
ACCEPT, RECOVER, CONFLICT, LEAD, APART, MATCHED = 0.45, 0.55, 0.65, 0.15, 0.1, 0.65
OBJECT_ROLES = ["figure_object", "table_object"]
# Lines are wide and low: cells of this shape hold most of them in one or two.
LINE_CELL = {"x": 512.0, "y": 64.0}


def unique_blocks(blocks: DataFrame, keys: list[str], width: str = "target_width", height: str = "target_height") -> DataFrame:
    """Blocks scaled to the page's size and without repeats: one a page, kind, box to hundredths and text key,
    the first by ``block_id``. ``source_width`` and ``source_height`` (null: as the page) are those of ``box``."""
    sx = F.when((F.col("source_width") > 0) & (F.col("source_height") > 0), F.col(width) / F.col("source_width"))
    sy = F.when(sx.isNotNull(), F.col(height) / F.col("source_height"))
    scaled = F.when(F.col("box").isNotNull(), F.struct(*(F.col("box")[c] * F.coalesce(s, F.lit(1.0)) for c, s in (("x0", sx), ("y0", sy), ("x1", sx), ("y1", sy)))))
    named = scaled.cast("struct<x0:double,y0:double,x1:double,y1:double>")
    found = blocks.withColumn("box", named).withColumn("_key", X.letters_key(F.col("text")))
    near = [F.round(F.col("box")[c], 2).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]
    first = found.groupBy(*keys, "kind", *near, "_key").agg(F.min_by(F.struct(*(c for c in found.columns if c not in (*keys, "kind", "_key"))), "block_id").alias("_row"))
    return first.select(*keys, "kind", "_row.*")


def _lines_in(blocks: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """block_id, spatial_score, spatial: the lines that lie in the box, in reading order, summed up."""
    wide = blocks.filter("inside").select(*keys, "block_id", G.expand(F.col("box"), MARGIN).alias("outer"))
    share = G.coverage(F.col("line_box"), F.col("outer"))
    # lines meet blocks by id and box alone; what they hold joins those that are met
    each = lines.select(*keys, F.struct("line.line_id", "line.box").alias("_at"), "line")
    narrow = each.select(*keys, "_at", F.col("line.box").alias("line_box")).distinct()
    near = touching(narrow, wide, keys, "line_box", "outer", LINE_CELL).withColumn("share", share).filter(F.col("share") >= LINE_SHARE)
    met = near.select(*keys, "_at", "block_id", "share").join(each, [*keys, "_at"])
    placed = F.struct(F.col("line.box.y0").alias("y"), F.col("line.box.x0").alias("x"), "line.line_id", "line")
    found = met.groupBy(*keys, "block_id").agg(F.avg("share").alias("spatial_score"), F.array_sort(F.collect_list(placed)).alias("_placed"))
    return summed_up(found.select(*keys, "block_id", "spatial_score", F.transform("_placed", lambda p: p["line"]).alias("lines")), "spatial")


def native_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """native_id, native (its lines, in order, summed up) and key of each native block."""
    own = lines.groupBy(*keys, "line.native_id").agg(F.array_sort(F.collect_list(F.struct("line.line_id", "line"))).alias("_own"))
    ordered = own.withColumn("lines", F.transform("_own", lambda p: p["line"])).drop("_own")
    return summed_up(ordered, "native").withColumn("key", X.letters_key(F.col("native.text")))


def summed_up(df: DataFrame, name: str) -> DataFrame:
    """``lines`` as one struct: their number, ids, text, box and style."""
    box = F.struct(*(f(F.col(f"lines.box.{c}")).alias(c) for c, f in (("x0", F.array_min), ("y0", F.array_min), ("x1", F.array_max), ("y1", F.array_max))))
    text = F.array_join(F.transform("lines", lambda x: x["text"]), " ")
    whole = F.struct(F.size("lines").alias("n"), F.transform("lines", lambda x: x["line_id"]).alias("ids"), text.alias("text"), box.alias("box"), F.col("style"))
    return with_style(df, "lines").withColumn(name, whole).drop("lines", "style")


def _recovered(blocks: DataFrame, native: DataFrame, keys: list[str]) -> DataFrame:
    """block_id, recovery_score, recovery: the native block of most similar text, the first on a tie.

    A score below RECOVER decides nothing and isn't looked for. It needs lengths within a ratio of
    RECOVER / (2 - RECOVER), so blocks meet in neighbouring length classes only."""
    least = RECOVER / (2 - RECOVER)
    step = lambda c: F.floor(F.log(F.length(c).cast("double")) / F.log(F.lit(1 / least))).cast("int")
    asked = blocks.filter("block_key != ''").select(*keys, "block_id", "block_key", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: d + step("block_key"))).alias("_step"))
    given = native.filter("key != ''").withColumn("_step", step("key"))
    near = asked.join(given, [*keys, "_step"]).filter(F.least(F.length("key"), F.length("block_key")) >= least * F.greatest(F.length("key"), F.length("block_key")))
    scored = near.withColumn("score", keys_similarity(F.col("block_key"), F.col("key"), RECOVER)).filter(F.col("score") >= RECOVER)
    best = scored.groupBy(*keys, "block_id").agg(F.min_by(F.struct("score", "native"), F.struct(-F.col("score"), "native_id")).alias("_best"))
    return best.select(*keys, "block_id", F.col("_best.score").alias("recovery_score"), F.col("_best.native").alias("recovery"))


def _object_boxes(blocks: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """block_id, object_box: the object that covers a figure's or table's box best, or is covered; then the largest."""
    asked = blocks.filter(F.col("inside") & F.col("role").isin(OBJECT_ROLES)).select(*keys, "block_id", F.col("box").alias("block_box"))
    met = touching(asked, objects.select(*keys, "object_id", F.col("box").alias("object_box")), keys, "block_box", "object_box")
    share = F.greatest(G.coverage(F.col("object_box"), F.col("block_box")), G.coverage(F.col("block_box"), F.col("object_box")))
    held = met.filter(G.valid(F.col("object_box"))).withColumn("share", share).filter(F.col("share") >= OBJECT_SHARE)
    return held.groupBy(*keys, "block_id").agg(F.min_by("object_box", F.struct(-F.col("share"), -G.area(F.col("object_box")), "object_id")).alias("object_box"))


def with_style(df: DataFrame, lines: str) -> DataFrame:
    """Adds ``style``, a struct of what the spans of the lines say (null without lines). Fonts weigh by characters."""
    weight = lambda s: F.greatest(F.lit(1), s["chars"])
    total = lambda chosen: F.aggregate(chosen, F.lit(0).cast("bigint"), lambda n, s: n + weight(s))
    df = settled(df, _spans=F.flatten(F.transform(lines, lambda x: x["spans"])), _ys=F.array_sort(F.filter(F.transform(lines, lambda x: x["baseline"]), lambda y: y.isNotNull())))
    names = F.array_sort(F.array_distinct(F.filter(F.transform("_spans", lambda s: s["font"]), lambda f: f.isNotNull())))
    later, earlier = (F.slice("_ys", F.lit(i), F.greatest(F.size("_ys") - 1, F.lit(0))) for i in (2, 1))
    gaps = F.array_sort(F.filter(F.zip_with(later, earlier, lambda q, p: q - p), lambda g: g.between(5, 30)))
    df = settled(df, _sizes=F.array_sort(F.transform("_spans", lambda s: F.struct(s["size"].alias("size"), weight(s).alias("w")))), _fonts=F.transform(names, lambda f: F.struct(total(F.filter("_spans", lambda s: s["font"] == f)).alias("w"), f.alias("font"))), _gaps=gaps, _all=total(F.col("_spans")))
    start = F.struct(F.lit(0).cast("bigint").alias("run"), F.lit(None).cast("double").alias("at"))
    median = F.aggregate("_sizes", start, lambda a, s: F.struct((a["run"] + s["w"]).alias("run"), F.when(a["at"].isNull() & ((a["run"] + s["w"]) * 2 >= F.col("_all")), s["size"]).otherwise(a["at"]).alias("at")))["at"]
    heaviest = F.array_max(F.transform("_fonts", lambda x: x["w"]))
    n = F.size("_gaps")
    middle = (F.get("_gaps", ((n - 1) / 2).cast("int")) + F.get("_gaps", (n / 2).cast("int"))) / 2
    share = lambda field: F.try_divide(total(F.filter("_spans", lambda s: s[field])), F.col("_all"))
    style = F.struct(F.get(F.filter("_fonts", lambda x: x["w"] == heaviest), F.lit(0))["font"].alias("font"), median.alias("size"), share("bold").alias("bold"), share("italic").alias("italic"), F.when(n > 0, middle).alias("gap"))
    return df.withColumn("style", F.when(F.size(lines) > 0, style)).drop("_spans", "_ys", "_sizes", "_fonts", "_gaps", "_all")


def fuse_blocks(blocks: DataFrame, lines: DataFrame, objects: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """``blocks``: ``keys``, block_id, role, text, box (struct or null). ``lines``: keys, line (struct of line_id,
    native_id, text, box, baseline, spans). ``objects``: keys, object_id, box. ``pages``: keys, width, height.

    One row a block: text, box and style as fused, the scores, where the box came from and why, and the
    lines taken. A null text counts as empty."""
    given = _given(blocks.join(pages, keys, "left")).withColumn("block_key", X.letters_key(F.col("text")))
    found = given
    for more in (_lines_in(given, lines, keys), _recovered(given, native_blocks(lines, keys), keys), _object_boxes(given, objects, keys)):
        found = found.join(more, [*keys, "block_id"], "left")
    return _scored(found, keys)


def fuse_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """As ``fuse_blocks``, for pages that come as rows: ``keys``, width, height, and the page's few blocks (block_id, role,
    text, box), lines, natives (native_id, lines in order) and objects (object_id, box) as arrays. A block looks at
    all of its page where it is, so nothing travels but the texts that need a ratio, to Python."""
    joined = F.transform("natives", lambda x: F.array_join(F.transform(x["lines"], lambda y: y["text"]), " "))
    keyed = pages.withColumns({"_block_keys": X.letters_keys(F.transform("blocks", lambda x: x["text"])), "_native_keys": X.letters_keys(joined)})
    blocks = F.zip_with("blocks", "_block_keys", lambda x, k: F.struct(*(x[c].alias(c) for c in ("block_id", "role", "text", "box")), k.alias("block_key")))
    natives = F.zip_with("natives", "_native_keys", lambda x, k: F.struct(x["native_id"].alias("native_id"), k.alias("key"), x["lines"].alias("lines")))
    rows = settled(keyed.select(*keys, "blocks", "lines", "natives", "objects", "width", "height", "_block_keys", "_native_keys"), _blocks=blocks, _natives=natives)
    given = _given(rows.select(*keys, F.explode("_blocks").alias("_b"), "lines", F.col("_natives").alias("natives"), "objects", "width", "height").select(*keys, "_b.*", "lines", "natives", "objects", "width", "height"))
    outer = G.expand(F.col("box"), MARGIN)
    each = lambda x: F.struct(x["box"]["y0"].alias("y"), x["box"]["x0"].alias("x"), x["line_id"].alias("line_id"), G.coverage(x["box"], outer).alias("share"), x.alias("line"))
    placed = F.array_sort(F.filter(F.transform("lines", each), lambda x: x["share"] >= LINE_SHARE))
    cover = lambda x: F.greatest(G.coverage(x["box"], F.col("box")), G.coverage(F.col("box"), x["box"]))
    held = F.filter("objects", lambda x: G.valid(x["box"]) & (cover(x) >= OBJECT_SHARE))
    best = F.array_min(F.transform(held, lambda x: F.struct((-cover(x)).alias("share"), (-G.area(x["box"])).alias("area"), x["object_id"].alias("object_id"), x["box"].alias("box"))))
    found = settled(given, _placed=F.when(F.col("inside"), placed), object_box=F.when(F.col("inside") & F.col("role").isin(OBJECT_ROLES), best["box"]))
    n = F.coalesce(F.size("_placed"), F.lit(0))
    found = found.withColumn("spatial_score", F.when(n > 0, F.aggregate("_placed", F.lit(0.0), lambda a, x: a + x["share"]) / n))
    found = _page_recovered(found.withColumn("_here", F.when(n > 0, F.transform("_placed", lambda x: x["line"]))).drop("lines", "objects", "_placed"))
    for name, lines in (("spatial", "_here"), ("recovery", "_there")):
        found = summed_up(found.withColumn("lines", F.col(lines)), name).withColumn(name, F.when(F.col(lines).isNotNull(), F.col(name))).drop(lines)
    return _scored(found, keys)


def _page_recovered(blocks: DataFrame) -> DataFrame:
    """Adds recovery_score and _there, the lines of the native block of most similar text, in place of ``natives``.

    A ratio is worked out only where lengths allow more than what containment gives the block, or as much."""
    least = RECOVER / (2 - RECOVER)
    key = F.col("block_key")
    short, long = (lambda x: F.least(F.length(x["key"]), F.length(key))), (lambda x: F.greatest(F.length(x["key"]), F.length(key)))
    near = F.filter("natives", lambda x: (x["key"] != "") & (key != "") & (short(x) >= least * long(x)))
    holds = lambda x: F.contains(x["key"], key) | F.contains(key, x["key"])
    known = F.transform(near, lambda x: F.struct(x["native_id"].alias("native_id"), x["key"].alias("key"), x["lines"].alias("lines"), F.when(holds(x), short(x) / long(x)).alias("share"), (2 * short(x) / (short(x) + long(x))).alias("bound")))
    found = settled(blocks, _near=known).drop("natives")
    found = settled(found, _most=F.coalesce(F.array_max(F.transform("_near", lambda x: x["share"])), F.lit(0.0)))
    asked = F.filter("_near", lambda x: x["share"].isNull() & (x["bound"] >= F.greatest(F.col("_most"), F.lit(RECOVER))) & (F.col("_most") < 1))
    first = F.array_min(F.transform(F.filter("_near", lambda x: (x["share"] >= RECOVER) & (x["share"] == F.col("_most"))), lambda x: F.struct((-x["share"]).alias("score"), x["native_id"].alias("native_id"), x["lines"].alias("lines"))))
    found = settled(found, _asked=asked, _first=first).drop("_near", "_most")
    some = F.size("_asked") > 0
    found = found.withColumn("_ratios", matching_ratios(F.when(some, key), F.when(some, F.transform("_asked", lambda x: x["key"])), RECOVER))
    tried = F.filter(F.zip_with("_asked", F.coalesce("_ratios", F.array().cast("array<double>")), lambda x, r: F.struct((-r).alias("score"), x["native_id"].alias("native_id"), x["lines"].alias("lines"))), lambda x: x["score"] <= -RECOVER)
    best = F.array_min(F.concat(F.array_compact(F.array("_first")), tried))
    return settled(found, _best=best).withColumns({"recovery_score": -F.col("_best.score"), "_there": F.col("_best.lines")}).drop("_asked", "_first", "_ratios", "_best")


def _given(blocks: DataFrame) -> DataFrame:
    """Blocks with their page's size: no text is an empty one, boxes that are none are null, and what lies on the page."""
    given = blocks.withColumn("text", F.coalesce("text", F.lit("")))
    fine = F.coalesce(G.valid(F.col("box")), F.lit(False))
    given = given.withColumn("box", F.when(fine, F.col("box"))).withColumn("inside", F.coalesce(G.inside_page(F.col("box"), F.col("width"), F.col("height")), F.lit(False)))
    return given


def _scored(found: DataFrame, keys: list[str]) -> DataFrame:
    found = found.withColumns({"spatial_score": F.coalesce("spatial_score", F.lit(0.0)), "recovery_score": F.coalesce("recovery_score", F.lit(0.0)), "place_key": X.letters_key(F.col("spatial.text"))})
    score = keys_similarity(F.col("block_key"), F.col("place_key"))
    return _decided(found.withColumn("place_text_score", F.when(F.col("spatial").isNotNull() & (F.col("text") != ""), score).otherwise(0.0)), keys)


def _decided(found: DataFrame, keys: list[str]) -> DataFrame:
    empty, here, there = F.col("text") == "", F.col("spatial").isNotNull(), F.col("recovery").isNotNull()
    leads = F.col("recovery_score") - F.col("place_text_score") >= LEAD
    apart = F.coalesce(G.iou(F.col("box"), F.col("recovery.box")), F.lit(0.0)) < APART
    native = F.col("object_box").isNotNull()
    by_place = (
        F.when(empty, "content_envelope_no_text_cross_check").when(there & leads & apart & (F.col("recovery_score") >= CONFLICT), "rejected_used_native")
        .when(F.col("place_text_score") >= ACCEPT, "accepted_cross_checked").when(there & leads, "rejected_used_native").otherwise("unresolved_text_mismatch")
    )
    elsewhere = F.when(there, "rejected_used_native").when(~empty, "unresolved_no_native_match").otherwise("unverifiable")
    found = settled(found, box_status=F.when(empty & native, "accepted_cross_checked_native_object").otherwise(F.when(here, by_place).otherwise(elsewhere)))
    is_ = lambda name: F.col("box_status") == name
    used = is_("rejected_used_native")
    reasons = F.array_compact(F.array(
        F.when(F.col("box").isNull(), "missing_or_invalid_box").when(~F.col("inside"), "box_outside_page"),
        F.when(used, F.when(here, "text_conflicts_with_box").otherwise("no_matching_text_at_box"))
        .when(is_("unresolved_text_mismatch"), "text_in_box_does_not_match").when(is_("unresolved_no_native_match"), "no_reliable_text_match"),
    ))
    taken = F.when(used, F.col("recovery")).when(~is_("unresolved_text_mismatch"), F.col("spatial"))
    found = settled(found, reasons=reasons, taken=taken, text_score=F.when(used, F.col("recovery_score")).otherwise(F.col("place_text_score")))
    some = F.col("taken").isNotNull()
    by_score = F.least(F.lit(1.0), 0.55 * F.col("text_score") + 0.45 * F.col("spatial_score"))
    confidence = F.when(used, F.col("recovery_score")).when(some & empty, F.greatest(by_score, 0.75 * F.col("spatial_score"))).otherwise(by_score)
    method = F.when(empty & native, "native_object").when(used, "text_recovery").when(some, "box_cross_checked").otherwise("none")
    native_box, native_text = F.coalesce("object_box", "taken.box"), F.trim("taken.text")
    return found.select(
        *keys, "block_id", "role", F.when(native_text != "", native_text).otherwise(F.col("text")).alias("text"), F.coalesce(native_box, "box").alias("box"),
        F.when(native, "native_object").when(some, "native_lines").otherwise("semantic").alias("box_source"), F.coalesce(G.iou(F.col("box"), native_box), F.lit(0.0)).alias("iou"),
        "spatial_score", "place_text_score", "recovery_score", "text_score", confidence.alias("confidence"), method.alias("method"),
        F.when(some & (confidence >= MATCHED), "matched").when(some, "low_confidence").otherwise("unmatched").alias("status"),
        "box_status", "inside", "reasons", F.coalesce("taken.ids", F.array().cast("array<bigint>")).alias("line_ids"), F.col("taken.style").alias("style"),
    )
