"""Review units of a document: which facts are looked at together, and how units over a budget are split.

``facts``: doc_id, position (their order), evidence_id, page, role, section, quote. A fact may belong to several
units: its section's, that of figures and tables, and the global one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import settled

# Roles, terms and patterns that results depend on.
FRONT_ROLES = ["title", "document_title", "author", "authors", "affiliation", "front_matter"]
GRAPHIC_ROLES = ["native_image_object", "native_vector_graphic_object"]
REFERENCE_TERMS = ["references", "bibliography"]
GRAPHIC_TERMS = ["figure", "fig.", "table"]
HEADING_ROLES = ["heading", "title", "section"]
APPENDIX = r"(?i)^(?:appendix\b|[A-Z]\.\s+)"
KINDS = ["front_matter", "abstract", "body_section", "figure_table", "reference", "appendix", "global"]
TITLES = ["Front matter", "Abstract", None, "Figures and tables", "References", "Appendix", "Global layout"]
PAGES_A_UNIT = 2
MOST_DEPTH = 8


def _names(terms: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce("quote", F.lit("")), F.coalesce("role", F.lit("")), F.coalesce("section", F.lit(""))))
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def _marked(facts: DataFrame, heading_roles: list[str], carried: Sequence[str] = ()) -> DataFrame:
    """Facts with what they say of themselves."""
    section, role = F.trim(F.coalesce("section", F.lit(""))), F.lower(F.coalesce("role", F.lit("")))
    heads = section.rlike(APPENDIX) | (role.isin(heading_roles) & F.trim(F.coalesce("quote", F.lit(""))).rlike(APPENDIX))
    root = F.nullif(F.regexp_extract(section, r"^(\d+)(?:\s|\.|$)", 1), F.lit(""))
    return facts.select(
        "doc_id", "position", "evidence_id", F.coalesce("page", F.lit(0)).alias("page"), section.alias("section"), role.alias("role"), root.alias("root"),
        section.rlike(r"^\d+(?:\s+|\.\s+)").alias("names_root"), F.startswith(F.coalesce("role", F.lit("")), F.lit("derived_")).alias("derived"), _names(["abstract"]).alias("abstract"), _names(REFERENCE_TERMS).alias("refers"),
        (_names(GRAPHIC_TERMS) | F.coalesce(F.col("role").isin(GRAPHIC_ROLES), F.lit(False))).alias("graphic"), heads.alias("heads"), *carried,
    )


def _bounded(marked: DataFrame) -> DataFrame:
    """Facts with where the parts of their document begin; documents without a page have no units."""
    paged, of_doc = F.col("page") > 0, Window.partitionBy("doc_id")
    first = lambda c: F.min(F.when(c, F.col("page"))).over(of_doc)
    bounds = {"first_page": first(paged), "references_at": first(paged & F.col("refers")), "appendix_at": first(paged & F.col("heads")), "has_abstract": F.bool_or("abstract").over(of_doc)}
    return marked.filter("doc_id IS NOT NULL").select("*", *(c.alias(n) for n, c in bounds.items())).filter("first_page IS NOT NULL")


def _body_groups(known: DataFrame) -> DataFrame:
    """``known`` with ``body_part`` and ``body_title`` of its ``body`` facts: by numbered top-level section, in order of
    their first pages; facts without a number go with the section that began last on their page or before. Documents
    without numbers are cut into windows of PAGES_A_UNIT pages that have facts. Null for facts of no such group."""
    rooted, of_root = F.col("body") & F.col("root").isNotNull(), Window.partitionBy("doc_id", "body", "root")
    named = F.min(F.when(F.col("names_root"), F.struct("position", "section"))).over(of_root)
    started = known.withColumns({"_start": F.min("page").over(of_root), "_at": F.min("position").over(of_root), "_named": named})
    listed = F.struct(F.col("_start").alias("start"), F.col("_at").alias("at"), "root", F.coalesce("_named.section", F.concat(F.lit("Section "), F.col("root"))).alias("title"))
    placed = started.withColumn("_roots", F.collect_set(F.when(rooted, listed)).over(Window.partitionBy("doc_id")))
    placed = settled(placed.drop("_start", "_at", "_named"), roots=F.array_sort("_roots")).drop("_roots")
    begun = F.size(F.filter("roots", lambda r: r["start"] <= F.col("page")))
    own = F.array_position(F.transform("roots", lambda r: r["root"]), F.col("root")).cast("int")
    numbered, paged = F.col("body") & (F.size("roots") > 0), F.col("body") & (F.size("roots") == 0) & (F.col("page") > 0)
    dense = F.ceil(F.dense_rank().over(Window.partitionBy("doc_id", "_paged").orderBy("page")) / PAGES_A_UNIT)
    part = F.when(numbered, F.when(F.col("root").isNotNull(), own).otherwise(F.greatest(begun, F.lit(1)))).when(F.col("_paged"), F.col("_dense"))
    parted = placed.withColumn("_paged", paged).withColumn("_dense", dense).withColumn("body_part", part.cast("int"))
    edge = lambda f: f("page").over(Window.partitionBy("doc_id", "_paged", "body_part")).cast("string")
    title = F.when(F.col("_paged"), F.concat(F.lit("Body pages "), edge(F.min), F.lit("-"), edge(F.max))).otherwise(F.get("roots", F.col("body_part") - 1)["title"])
    return parted.withColumn("body_title", title).drop("roots", "_paged", "_dense")


def unit_members(facts: DataFrame, heading_roles: list[str] = HEADING_ROLES, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, kind, part (within the kind), title, evidence_id, position, page, and the columns ``carried``: each fact
    of each unit.

    ``heading_roles``: roles whose quotes may begin the appendix, as sections do. Facts are read and dealt by document
    once, without their texts; what a document or section says of a fact comes from windows."""
    known = _bounded(_marked(facts, heading_roles, carried))
    on_first = F.col("page") == F.col("first_page")
    opening = on_first & ~F.col("abstract") & (F.col("role").isin(FRONT_ROLES) | ~F.col("section").rlike(r"^\d+(?:\s|\.|$)"))
    # a document whose first page has no opening facts opens with the whole page
    known = settled(known, opening=opening).withColumn("has_front", F.bool_or("opening").over(Window.partitionBy("doc_id")))
    before = F.col("references_at").isNull() | (F.col("page") < F.col("references_at"))
    grouped = _body_groups(known.withColumn("body", ~F.col("abstract") & ~F.col("opening") & ~F.col("derived") & before))
    belongs = {
        "front_matter": F.when(F.col("has_front"), F.col("opening")).otherwise(on_first),
        "abstract": F.when(F.col("has_abstract"), F.col("abstract")).otherwise(on_first),
        "body_section": F.col("body_part").isNotNull(),
        "figure_table": F.col("graphic"),
        "reference": (F.col("page") >= F.col("references_at")) & (F.col("appendix_at").isNull() | (F.col("page") < F.col("appendix_at"))),
        "appendix": F.col("page") >= F.col("appendix_at"),
        "global": F.lit(True),
    }
    fixed = dict(zip(KINDS, TITLES, strict=True))
    unit = lambda k: F.struct(F.lit(k).alias("kind"), (F.lit(1) if fixed[k] else F.col("body_part")).alias("part"), (F.lit(fixed[k]) if fixed[k] else F.col("body_title")).alias("title"))
    units = F.array_compact(F.array(*(F.when(c, unit(k)) for k, c in belongs.items())))
    return grouped.select("doc_id", F.inline(units), "evidence_id", "position", "page", *carried)


def plan_units(facts: DataFrame, heading_roles: list[str] = HEADING_ROLES) -> DataFrame:
    """doc_id, unit (from 1, in order), kind, title, first_page, last_page, n_facts, first_fact (by position).

    Facts without a page count in a unit, not in its range of pages."""
    units = unit_members(facts, heading_roles).groupBy("doc_id", "kind", "part", "title").agg(
        F.min(F.when(F.col("page") > 0, F.col("page"))).alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_facts"), F.min_by("evidence_id", "position").alias("first_fact"))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    order = Window.partitionBy("doc_id").orderBy(rank, "part")
    return units.select("doc_id", F.row_number().over(order).alias("unit"), "kind", "title", "first_page", "last_page", "n_facts", "first_fact")


def refine_units(units: DataFrame, budget: int, base: int = 0, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Units over ``budget`` halved until they fit: by rules while they have several, then by pages.

    ``units``: doc_id, unit, title, rules (array of struct id, tokens), pages (array of struct page, tokens; pages
    that have facts). Both are sorted here, and a child is a range of each, so its size is a difference of
    running sums; all halvings of a unit happen in one fold of its row, nothing is exchanged but for numbering.

    doc_id, unit (from 1 in the document), parent, title, rule_ids, first_page, last_page, tokens, depth, status:
    not_needed (no rules), within_budget, or minimum_unit_exceeds_budget (one rule and page, or ``most_depth``).
    """
    rules, pages = F.array_sort("rules"), F.array_sort("pages")
    none = F.array(F.lit(0).cast("bigint"))
    runs = lambda items: F.aggregate(items, none, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["tokens"])))
    given = settled(units.select("doc_id", F.col("unit").alias("parent"), "title", rules.alias("rules"), pages.alias("pages")), _r=runs(F.col("rules")), _p=runs(F.col("pages")))

    def piece(r0: Column, r1: Column, p0: Column, p1: Column, depth: Column, note: Column) -> Column:
        return F.struct(*(c.cast("int").alias(n) for c, n in ((r0, "r0"), (r1, "r1"), (p0, "p0"), (p1, "p1"), (depth, "depth"))), note.alias("note"))

    def size(x: Column) -> Column:
        return base + F.get("_r", x["r1"]) - F.get("_r", x["r0"]) + F.get("_p", x["p1"]) - F.get("_p", x["p0"])

    def halves(x: Column) -> Column:
        d = x["depth"] + 1
        r, p = F.floor((x["r0"] + x["r1"]) / 2), F.floor((x["p0"] + x["p1"]) / 2)
        named = lambda kind, i: F.concat(x["note"], F.lit(f" ({kind} {i}/2)"))
        by_rules = F.array(piece(x["r0"], r, x["p0"], x["p1"], d, named("rules", 1)), piece(r, x["r1"], x["p0"], x["p1"], d, named("rules", 2)))
        by_pages = F.array(piece(x["r0"], x["r1"], x["p0"], p, d, named("refined", 1)), piece(x["r0"], x["r1"], p, x["p1"], d, named("refined", 2)))
        whole = F.array(piece(x["r0"], x["r1"], x["p0"], x["p1"], x["depth"], x["note"]))
        fits = (size(x) <= budget) | (x["r1"] == 0)
        return F.when(fits, whole).when(x["r1"] - x["r0"] > 1, by_rules).when(x["p1"] - x["p0"] > 1, by_pages).otherwise(whole)

    zero = F.lit(0)
    first = F.array(piece(zero, F.size("rules"), zero, F.size("pages"), zero, F.lit("")))
    split = F.aggregate(F.sequence(F.lit(1), F.lit(most_depth)), first, lambda state, _: F.flatten(F.transform(state, halves))) if most_depth else first
    each = given.select("*", F.posexplode(split).alias("leaf", "x")).withColumn("tokens", size(F.col("x")))
    status = F.when(F.size("rules") == 0, "not_needed").when(F.col("tokens") <= budget, "within_budget").otherwise("minimum_unit_exceeds_budget")
    held = F.slice("pages", F.col("x.p0") + 1, F.col("x.p1") - F.col("x.p0"))
    order = Window.partitionBy("doc_id").orderBy("parent", "leaf")
    return each.select(
        "doc_id", F.row_number().over(order).alias("unit"), "parent", F.concat("title", "x.note").alias("title"), F.transform(F.slice("rules", F.col("x.r0") + 1, F.col("x.r1") - F.col("x.r0")), lambda r: r["id"]).alias("rule_ids"),
        F.get(held, F.lit(0))["page"].alias("first_page"), F.get(held, F.size(held) - 1)["page"].alias("last_page"), "tokens", F.col("x.depth").alias("depth"), status.alias("status"),
    )
