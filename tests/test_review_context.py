"""Native blocks, context passes and layout JSON against plain loops and literals."""

from __future__ import annotations

import collections
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.operators.native_text import tagged_blocks
from quirework.plans import context
from quirework.sources.layout_json import blocks_in, layout_blocks

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def walked(lines: list[tuple]) -> list[tuple]:
    """(page, role, section, text) of one document's blocks, line by line."""
    weights = collections.Counter()
    for _, _, _, text, size in lines:
        weights[round(size, 1)] += len(text.strip())
    body = max(weights, key=lambda s: weights[s])  # the first of equals
    out: list[tuple] = []
    section = ""

    def role_of(text: str, page: int, size: float) -> str:
        if page == 1 and size >= body + 4 and len(text) <= 240:
            return "title"
        if text.rstrip(":").lower() in ("abstract", "references", "bibliography", "acknowledgments", "acknowledgements"):
            return "heading"
        return "heading" if len(text) <= 160 and size >= body + 0.5 and re.match(r"^\d+(?:\.\d+)*\.?\s+\S", text) else "paragraph"

    raw = collections.OrderedDict()
    for line in lines:
        if line[3].strip():
            raw.setdefault((line[1], line[2]), []).append(line)
    for (page, _), own in raw.items():
        pending: list[str] = []
        heading: list[str] = []

        def flush(page: int = page) -> None:
            nonlocal section, pending, heading
            if pending:
                out.append((page, "reference_entry" if section.lower() in ("references", "bibliography") else "paragraph", section, " ".join(pending)))
                pending = []
            if heading:
                section = " ".join(heading)
                out.append((page, "heading", section, section))
                heading = []

        for _, _, _, text, size in own:
            text = text.strip()
            if re.fullmatch(r"\d+(?:\.\d+)*\.?", text) and size >= body + 0.5:
                flush()
                heading = [text]
            elif heading and size >= body + 0.5:
                heading.append(text)
            else:
                if heading:
                    flush()
                role = role_of(text, page, size)
                if role == "paragraph":
                    pending.append(text)
                else:
                    flush()
                    section = text if role == "heading" else section
                    out.append((page, role, text if role == "heading" else "", text))
        flush()
    return out


def test_native_blocks(spark):  # noqa: ANN001, ANN201
    rng = random.Random(6)
    texts = ["1", "2.3", "4.", "1 Introduction", "References", "abstract:", "some words here", "more of it", " ", "Bibliography", "3. Results and more", "x" * 170]
    rows, expected = [], {}
    for d in range(40):
        lines, block = [], 0
        for i in range(rng.randint(1, 30)):
            block += rng.random() < 0.3
            lines.append((i, 1 + block // 4, block, rng.choice(texts), rng.choice([10.0, 10.0, 10.0, 10.5, 12.0, 14.0, 9.0])))
        if not any(x[3].strip() for x in lines):
            continue
        expected[d] = walked(lines)
        rows += [(d, *x[:3], x[3], (1.0 * x[0], 2.0, 3.0 + x[0], 4.0), x[4]) for x in lines]
    df = spark.createDataFrame(rows, f"doc_id int, position int, page int, raw_block int, text string, box {BOX}, max_size double").repartition(3)
    found = collections.defaultdict(list)
    for r in tagged_blocks(df, ["doc_id"]).orderBy("doc_id", "block").collect():
        found[r["doc_id"]].append((r["page"], r["role"], r["section"], r["text"]))
    assert dict(found) == expected
    assert {x[1] for b in expected.values() for x in b} == {"title", "heading", "paragraph", "reference_entry"}


# ---------------------------------------------------------------- context

SCHEMA = "doc_id int, position int, evidence_id string, page int, role string, section string, quote string, source string, font_size double, page_width double, rule_categories array<string>"


def picked(facts: list[tuple], category: str, most: int) -> list[tuple]:
    relevant_names = context.DERIVED.get(category)
    pictured = category in ("figure", "table")

    def relevant(f: tuple) -> bool:
        role = f[4] or ""
        name = role.removeprefix("derived_")
        if not role.startswith("derived_"):
            return False
        if name == "rule_assessment":
            return category in (f[10] or [])
        return name in relevant_names if relevant_names else category in name or name in category

    ranked = []
    for f in facts:
        role, quote = f[4] or "", f[6] or ""
        if role.startswith("derived_") and not relevant(f) or pictured and role == "paragraph" and not re.match(r"\s*(?:figure|fig\.|table)\s*\d+\b", quote, re.I):
            continue
        terms = 8 * sum(t in " ".join([quote, role, f[5] or ""]).lower() for t in context.TERMS.get(category, []))
        graphic = pictured and role in context.GRAPHIC_ROLES
        if pictured and not terms and not graphic and not relevant(f):
            continue
        score = terms + 40 * relevant(f) + 8 * graphic + 6 * (category == "page_layout" and f[9] is not None) + 2 * (category == "heading" and f[8] is not None) + 3 * (f[7] == context.FUSED) + (role != context.RAW)
        ranked.append(((-score, role == context.RAW, f[3] or 0, f[2]), f))
    ranked.sort(key=lambda x: x[0])
    out = [(f[2], 1) for _, f in ranked if relevant(f)][:most]
    if len(out) >= most or any(f[4] == "derived_rule_assessment" for _, f in ranked if (f[2], 1) in out):
        return out
    pages, taken = set(), {x[0] for x in out}
    for want in (2, 3):
        for k, f in ranked:
            if len(out) < most and f[2] not in taken and ((f[3] or 0) not in pages if want == 2 else k[0] < 0):
                out.append((f[2], want))
                taken.add(f[2])
                pages.add((f[3] or 0) if want == 2 else -1)
    return out


def test_context_passes(spark):  # noqa: ANN001, ANN201
    rng = random.Random(10)
    roles = ["paragraph", "native_text_span", "native_image_object", "heading", None, "derived_captions", "derived_column_geometry", "derived_rule_assessment", "derived_abstract"]
    quotes = ["see Figure 2", "Figure 1: a picture", "Table 3", "an abstract", "the university and its email a@b", "conclusion", None, "plain", "references"]
    rows = []
    for d in range(30):
        some = rng.sample(roles, rng.randint(2, 9))
        rows += [(d, i, f"e{rng.randint(0, 10**9)}-{i}", rng.choice([None, 1, 2, 3, 4]), rng.choice(some), rng.choice([None, "1 Introduction", "x"]), rng.choice(quotes), rng.choice([context.FUSED, "x", None]), rng.choice([None, 9.0]), rng.choice([None, 600.0]), rng.choice([None, ["figure"], ["heading", "table"]])) for i in range(rng.randint(1, 25))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for category in ("figure", "table", "heading", "abstract", "page_layout", "author_identity", "unknown"):
        for most in (4, 56):
            found = collections.defaultdict(list)
            for r in context.category_context(df, category, most).orderBy("doc_id", "place").collect():
                found[r["doc_id"]].append((r["evidence_id"], r["pass"]))
            expected = {d: p for d in range(30) if (p := picked([r for r in rows if r[0] == d], category, most))}
            assert dict(found) == expected, (category, most)


def test_global_context(spark):  # noqa: ANN001, ANN201
    rows = [
        (1, 0, "b", 1, "paragraph", "", "x", None, None, 600.0, None), (1, 1, "a", 1, "paragraph", "", "x", None, None, 600.0, None), (1, 2, "c", 2, "paragraph", "", "an author", None, None, None, None), (1, 3, "d", 3, "derived_x", "", "", None, None, 600.0, None),
        (1, 4, "e", 2, "paragraph", "", "y", None, None, 600.0, None), (1, 5, "f", None, "paragraph", "References", None, None, None, 600.0, None), (1, 6, "g", 9, "derived_y", "", "", None, None, None, None), (1, 7, "h", 3, None, "", "nothing", None, None, None, None),
    ]
    found = context.global_context(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    assert [(r["evidence_id"], r["pass"]) for r in found] == [("d", 1), ("g", 1), ("a", 2), ("e", 2), ("c", 3), ("f", 3)]
    assert context.global_context(spark.createDataFrame(rows, SCHEMA), 3).count() == 3


# ---------------------------------------------------------------- layout JSON


def test_layout_json_of_both_shapes(spark):  # noqa: ANN001, ANN201
    inner = {"type": "image_caption", "bbox": [1, 2, 30, 4], "lines": [{"spans": [{"content": "Fig. 2:"}, {"content": "a  cat"}, {"x": 1}]}, 7], "blocks": [{"type": "text", "text": "deep", "bbox": [0, 0, 5, 5]}]}
    tree = {"pdf_info": [{"page_idx": 0, "page_size": [100, 200], "para_blocks": [{"type": "title", "level": 1, "text": "The ti-\ntle", "bbox": [10, 20, 50, 30]}, {"type": "image", "bbox": [1, 2, 50, 60], "blocks": [inner]}, {"type": "weird", "blocks": [inner]}]}, {"page_idx": 1, "preproc_blocks": [{"type": "title", "level": 1, "text": "Later", "bbox": [3, 3, 1, 9]}, "no block"]}, None]}
    flat = [{"type": "text", "page_idx": 1, "text": "Table 4. of numbers", "bbox": [1, 2, 3, 4]}, {"type": "text", "page_idx": 1, "text": "TABLE 4 of  numbers", "bbox": [1, 2, 3, 4.001]}, {"type": "text", "text": "", "bbox": [1, 2, 3]}, {"type": "title", "text_level": 2, "text": "Two"}]
    rows = [(1, json.dumps(tree)), (2, json.dumps(flat)), (3, "[]")]
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0), (2, 2, 600.0, 800.0)], "doc_id int, page bigint, width double, height double")
    found = [tuple(r) for r in layout_blocks(spark.createDataFrame(rows, "doc_id int, layout string"), pages).orderBy("doc_id", "page", "block_id").collect()]
    box = lambda *v: tuple(map(float, v))
    assert [(*r[:8], r[8] and tuple(r[8])) for r in found] == [
        (1, 1, "p1-0-title", None, "title", "document_title", 1, "The title", box(60, 80, 300, 120)), (1, 1, "p1-1-0-0-text", "1.0", "text", "paragraph", None, "deep", box(0, 0, 30, 20)),
        (1, 1, "p1-1-0-image_caption", "1", "image_caption", "figure_caption", None, "Fig. 2: a cat", box(6, 8, 180, 16)), (1, 1, "p1-1-image", None, "image", "figure_object", None, "", box(6, 8, 300, 240)),
        (1, 2, "p2-0-title", None, "title", "section_heading", 1, "Later", None), (2, 1, "p1-2-text", None, "text", "paragraph", None, "", None), (2, 1, "p1-3-title", None, "title", "section_heading", 2, "Two", None),
        (2, 2, "p2-0-text", None, "text", "table_caption", None, "Table 4. of numbers", box(1, 2, 3, 4)),
    ]
    assert blocks_in("[]") == [] and blocks_in(None) is blocks_in("{") is blocks_in('{"x": 1}') is blocks_in('"text"') is None
    with pytest.raises(Exception, match="no layout: document 9"):
        layout_blocks(spark.createDataFrame([(9, '{"x": 1}')], "doc_id int, layout string"), pages).select(F.max("page")).collect()


# ---------------------------------------------------------------- profiles


def test_profile_of_ten_groups(spark):  # noqa: ANN001, ANN201
    from quirework.plans.assessment import SINGLE_COLUMN, assess

    good = {
        "frame_width": 396, "frame_left": 110, "frame_top": 72, "frame_right": 504, "body_size": 10, "line_gap": 11.5, "times_compatible": 1, "first_indent": -1.5, "paragraph_gap": 7.5, "title_size": 17, "title_bold": 1,
        "title_rules": 2, "title_off_centre": 3, "title_rules_above": 1, "title_rules_below": 1, "abstract_left_indent": 36, "abstract_right_indent": 41, "abstract_size": 10, "abstract_line_gap": 11, "abstract_paragraphs": 1,
        "abstract_heading_size": 12, "abstract_heading_bold": 0.9, "abstract_heading_off_centre": 8, "h1_size_off_12": 0.5, "h1_bold": 0.8, "h1_off_left": 0, "h2_count": 2, "h2_size_off_10": 0, "h3_count": 0, "reference_entries": 5,
        "references_named": 1, "references_numbered": 0, "entries_before_references": 0, "caption_kinds": 1, "captions_continuous": 1, "captions_below": 1, "captions_centred": 1,
    }
    bad = good | {"frame_top": 80, "body_size": 10.3, "paragraph_gap": None, "title_off_centre": None, "abstract_paragraphs": 2, "h1_size_off_12": None, "h2_size_off_10": 0.6, "h3_count": 1, "h3_size_off_10": float("nan"), "references_numbered": 1, "caption_kinds": 0}
    df = spark.createDataFrame([(1, {k: float(v) for k, v in good.items()}), (2, {k: None if v is None else float(v) for k, v in bad.items()}), (3, {})], "doc_id int, measures map<string,double>")
    rows = {(r["doc_id"], r["rule"][-2:]): r for r in assess(df, SINGLE_COLUMN).collect()}
    result = lambda d: [rows[d, f"{i:02}"]["result"][:6] for i in range(1, 11)]
    assert len(rows) == 30 and result(1) == ["compli"] * 7 + ["not_ap"] + ["compli"] * 2
    assert result(2) == ["non_co", "non_co", "unveri", "non_co", "non_co", "unveri", "non_co", "unveri", "non_co", "not_ap"]
    assert result(3) == ["unveri"] * 6 + ["not_ap"] * 2 + ["unveri", "not_ap"]
    assert rows[2, "04"]["failed"] == ["title_off_centre"] and rows[2, "03"]["missing"] == ["paragraph_gap"]
