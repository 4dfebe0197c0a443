"""Facts chosen as the context of a question about one category of rules, and of one about a whole document.

``facts``: doc_id, evidence_id, page, role, section, quote, source, font_size, page_width, rule_categories (array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Terms, roles and weights that results depend on.
TERMS = {
    "anonymity": ["author", "affiliation", "email", "acknowledg", "funding", "@"],
    "author_identity": ["affiliation", "email", "@", "university", "school", "institute", "department", "corresponding"],
    "abstract": ["abstract", "摘要"],
    "figure": ["figure", "fig.", "图", "caption"],
    "heading": ["heading", "section", "introduction", "conclusion", "references", "标题"],
    "reference": ["reference", "bibliography", "citation", "参考文献", "引用"],
    "table": ["table", "表格", "表 ", "tab."],
    "template": ["neurips", "latex", "style", "template", "submission"],
}
DERIVED = {
    "page_layout": ["page_geometry", "document_structure", "column_geometry", "body_geometry", "paragraph_metrics", "typography_inventory", "appendix_layout"],
    "appendix": ["page_geometry", "document_structure", "column_geometry", "typography_inventory", "appendix_layout"],
    "author_identity": ["front_matter", "front_matter_geometry", "column_geometry"],
    "anonymity": ["front_matter", "front_matter_geometry", "column_geometry"],
    "heading": ["front_matter", "front_matter_geometry", "heading_inventory", "column_geometry"],
    "reference": ["references", "citation_inventory", "reference_inventory"],
    "figure": ["captions", "caption_geometry", "column_geometry", "body_geometry"],
    "table": ["captions", "caption_geometry", "column_geometry", "body_geometry"],
}
CAPTION = r"(?i)^\s*(?:figure|fig\.|table)\s*\d+\b"
GRAPHIC_ROLES = ["native_image_object", "native_vector_graphic_object"]
RAW, FUSED = "native_text_span", "native_pdf+mineru"
PER_TERM, FOR_DERIVED, FOR_GRAPHIC, FOR_PAGE, FOR_FUSED, FOR_FONT, FOR_NOT_RAW = 8, 40, 8, 6, 3, 2, 1
MOST = 56
GLOBAL_TERMS = ["author", "acknowledg", "references", "bibliography", "page"]


def _role() -> Column:
    return F.coalesce("role", F.lit(""))


def _haystack() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("quote", F.lit("")), _role(), F.coalesce("section", F.lit(""))))


def derived_relevant(category: str) -> Column:
    """Whether a derived fact says something of the category."""
    name = F.regexp_replace(_role(), "^derived_", "")
    listed = F.coalesce(F.array_contains("rule_categories", category), F.lit(False))
    known = name.isin(DERIVED[category]) if category in DERIVED else F.contains(name, F.lit(category)) | F.contains(F.lit(category), name)
    return F.startswith(_role(), F.lit("derived_")) & F.when(name == "rule_assessment", listed).otherwise(known)


def ranked_facts(facts: DataFrame, category: str) -> DataFrame:
    """The facts that may serve the category, with ``score`` and ``rank`` in their document."""
    pictured = category in ("figure", "table")
    relevant, graphic = derived_relevant(category), _role().isin(GRAPHIC_ROLES) & F.lit(pictured)
    text = _haystack()
    found = sum((F.when(F.contains(text, F.lit(t)), PER_TERM).otherwise(0) for t in TERMS.get(category, [])), F.lit(0))
    score = found + F.when(relevant, FOR_DERIVED).otherwise(0) + F.when(graphic, FOR_GRAPHIC).otherwise(0) + F.when(F.coalesce(F.col("source") == FUSED, F.lit(False)), FOR_FUSED).otherwise(0) + F.when(_role() != RAW, FOR_NOT_RAW).otherwise(0)
    if category == "page_layout":
        score = score + F.when(F.col("page_width").isNotNull(), FOR_PAGE).otherwise(0)
    if category == "heading":
        score = score + F.when(F.col("font_size").isNotNull(), FOR_FONT).otherwise(0)
    fits = ~F.startswith(_role(), F.lit("derived_")) | relevant
    if pictured:  # prose that mentions a figure says nothing of its label, style or place
        fits = fits & ((_role() != "paragraph") | F.coalesce("quote", F.lit("")).rlike(CAPTION)) & ((found > 0) | graphic | relevant)
    kept = facts.filter(fits).withColumn("score", score).withColumn("relevant", relevant).withColumn("page", F.coalesce("page", F.lit(0)))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.when(_role() == RAW, 1).otherwise(0), "page", "evidence_id")
    return kept.withColumn("rank", F.row_number().over(order))


def category_context(facts: DataFrame, category: str, most: int = MOST) -> DataFrame:
    """doc_id, evidence_id, pass, score, place (from 1): at most ``most`` facts of each document, which is the feature.

    Pass 1: derived facts, by rank. Where an assessment of rules is among them nothing else is taken. Pass 2: the
    first fact of each page. Pass 3: what is left and has a score. Each pass goes by rank, and a document's facts
    are only numbered and cut; the cut leaves at most ``most`` rows a pass before they meet."""
    ranked = ranked_facts(facts, category)
    of_doc = Window.partitionBy("doc_id")
    derived = ranked.filter("relevant").withColumn("_n", F.row_number().over(of_doc.orderBy("rank"))).filter(F.col("_n") <= most).drop("_n")
    closed = derived.groupBy("doc_id").agg(F.count("*").alias("_taken"), F.bool_or(F.col("role") == "derived_rule_assessment").alias("_assessed"))
    rest = ranked.filter("NOT relevant").join(closed, "doc_id", "left").filter(F.coalesce(~F.col("_assessed") & (F.col("_taken") < most), F.lit(True)))
    first = rest.withColumn("_first", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("rank")) == 1)
    later = first.filter("_first OR score > 0").withColumn("pass", F.when(F.col("_first"), 2).otherwise(3))
    left = later.withColumn("_n", F.row_number().over(of_doc.orderBy("pass", "rank")) + F.coalesce("_taken", F.lit(0))).filter(F.col("_n") <= most)
    both = derived.withColumn("pass", F.lit(1)).select("doc_id", "evidence_id", "pass", "score", "rank").union(left.select("doc_id", "evidence_id", "pass", "score", "rank"))
    return both.withColumn("place", F.row_number().over(of_doc.orderBy("pass", "rank"))).drop("rank")


def global_context(facts: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, evidence_id, pass, place: derived facts in order of ``position``, then the first measured fact of each
    page, then facts that name authors, references or pages; at most ``most`` of a document."""
    derived = F.startswith(_role(), F.lit("derived_"))
    named = F.lit(False)
    for t in GLOBAL_TERMS:
        named = named | F.contains(_haystack(), F.lit(t))
    known = facts.withColumn("page", F.coalesce("page", F.lit(0))).withColumn("_derived", derived)
    measured = ~F.col("_derived") & (F.col("page") > 0) & F.col("page_width").isNotNull()
    on_page = F.row_number().over(Window.partitionBy("doc_id", "page", measured).orderBy("evidence_id")) == 1
    passes = F.when(F.col("_derived"), 1).when(measured & on_page, 2).when(named, 3)
    chosen = known.withColumn("pass", passes).filter("pass IS NOT NULL")
    within = F.when(F.col("pass") == 2, F.struct(F.col("page"), F.col("evidence_id"))).otherwise(F.struct(F.lit(0).cast(known.schema["page"].dataType).alias("page"), F.col("position").cast(known.schema["evidence_id"].dataType).alias("evidence_id")))
    order = Window.partitionBy("doc_id").orderBy("pass", within)
    return chosen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("doc_id", "evidence_id", "pass", "place")
