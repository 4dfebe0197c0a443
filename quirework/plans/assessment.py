"""Rules of a profile held against what was measured in a document: one of four results for each rule.

A rule is a row: conditions over named measures, and the measure that tells whether the rule applies at all. So
a profile is data, and a document is one row (doc_id, measures: map of name to double) that meets all rules
where it lies.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = "array<struct<rule:string,title:string,applies:string,conditions:array<struct<measure:string,test:string,target:double,tolerance:double,needed:boolean>>>>"
RESULTS = ["compliant", "non_compliant", "unverifiable", "not_applicable"]


def near(measure: str, target: float, tolerance: float, needed: bool = True) -> dict:
    return {"measure": measure, "test": "near", "target": target, "tolerance": tolerance, "needed": needed}


def least(measure: str, target: float, needed: bool = True) -> dict:
    return {"measure": measure, "test": "least", "target": target, "tolerance": 0.0, "needed": needed}


def most(measure: str, target: float, needed: bool = True) -> dict:
    return {"measure": measure, "test": "most", "target": target, "tolerance": 0.0, "needed": needed}


def known(measure: str) -> dict:
    """Holds whatever the value; without one the rule can't be verified."""
    return {"measure": measure, "test": "known", "target": 0.0, "tolerance": 0.0, "needed": True}


def rule(name: str, title: str, *conditions: dict, applies: str | None = None) -> dict:
    return {"rule": name, "title": title, "applies": applies, "conditions": list(conditions)}


# Measures in points, the ten groups of one venue's profile. A measure over several headings is their
# worst: the largest distance, the least share; it is null if there are none or one of them lacks it.
SINGLE_COLUMN = [
    rule("NIPS-01", "body frame", near("frame_width", 396, 3), near("frame_left", 108, 3), near("frame_top", 72, 3), known("frame_right")),
    rule("NIPS-02", "body font and line pitch", near("body_size", 10, 0.25), near("line_gap", 11, 0.5), least("times_compatible", 1)),
    rule("NIPS-03", "paragraphs", near("first_indent", 0, 1.5), near("paragraph_gap", 5.5, 2)),
    rule("NIPS-04", "title", near("title_size", 17, 0.5), least("title_bold", 0.9), known("title_rules"), most("title_off_centre", 8, needed=False), least("title_rules_above", 1, needed=False), least("title_rules_below", 1, needed=False)),
    rule(
        "NIPS-05", "abstract", near("abstract_left_indent", 36, 5), near("abstract_right_indent", 36, 5), near("abstract_size", 10, 0.5), near("abstract_line_gap", 11, 0.75), near("abstract_paragraphs", 1, 0),
        near("abstract_heading_size", 12, 0.5), least("abstract_heading_bold", 0.9), most("abstract_heading_off_centre", 8),
    ),
    rule("NIPS-06", "headings of level 1", most("h1_size_off_12", 0.5), least("h1_bold", 0.8, needed=False), most("h1_off_left", 3)),
    rule("NIPS-07", "headings of level 2", most("h2_size_off_10", 0.5), applies="h2_count"),
    rule("NIPS-08", "headings of level 3", most("h3_size_off_10", 0.5), applies="h3_count"),
    rule("NIPS-09", "references", known("reference_entries"), least("references_named", 1), most("references_numbered", 0), most("entries_before_references", 0, needed=False)),
    rule("NIPS-10", "figures and tables", least("captions_continuous", 1, needed=False), least("captions_below", 1, needed=False), least("captions_centred", 1, needed=False), applies="caption_kinds"),
]


def assess(documents: DataFrame, rules: list[dict]) -> DataFrame:
    """doc_id, rule, title, result, failed (measures whose condition doesn't hold, in order), missing (needed measures
    without a value). ``documents``: doc_id, measures.

    not_applicable: the rule's ``applies`` measure is null or 0. unverifiable: a needed measure has no value (null or
    not a number). Else compliant if all conditions hold; one without a value that isn't needed does not hold."""
    profile = F.from_json(F.lit(json.dumps(rules)), RULE)
    rows = documents.select("doc_id", "measures", F.explode(profile).alias("r"))

    def value(name: Column) -> Column:
        v = F.try_element_at("measures", name)
        return F.when(~F.isnan(v), v)

    def holds(c: Column) -> Column:
        v = value(c["measure"])
        kept = F.when(c["test"] == "near", F.abs(v - c["target"]) <= c["tolerance"]).when(c["test"] == "least", v >= c["target"]).when(c["test"] == "most", v <= c["target"]).otherwise(v.isNotNull())
        return F.coalesce(kept, F.lit(False))

    names = lambda chosen: F.transform(chosen, lambda c: c["measure"])
    applies = F.col("r.applies").isNull() | F.coalesce(value(F.col("r.applies")) != 0, F.lit(False))
    failed, missing = names(F.filter("r.conditions", lambda c: ~holds(c))), names(F.filter("r.conditions", lambda c: c["needed"] & value(c["measure"]).isNull()))
    found = rows.select("doc_id", "r.rule", "r.title", applies.alias("applies"), failed.alias("failed"), missing.alias("missing"))
    result = F.when(~F.col("applies"), RESULTS[3]).when(F.size("missing") > 0, RESULTS[2]).when(F.size("failed") == 0, RESULTS[0]).otherwise(RESULTS[1])
    return found.select("doc_id", "rule", "title", result.alias("result"), "failed", "missing")
