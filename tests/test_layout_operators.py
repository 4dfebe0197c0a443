"""Grid joins, fusion, runs of lines and review units against brute force on random pages."""

from __future__ import annotations

import collections
import difflib
import random

from pyspark.sql import functions as F

from quirework.operators.fusion import fuse_blocks, unique_blocks
from quirework.operators.sequences import holding_runs, similar_runs
from quirework.operators.spatial import touching
from quirework.plans.review_units import plan_units, refine_units

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
LINE = f"struct<line_id:bigint,native_id:bigint,text:string,box:{BOX},baseline:double,spans:array<struct<font:string,size:double,bold:boolean,italic:boolean,chars:bigint>>>"


def test_touching(spark):  # noqa: ANN001, ANN201
    rng = random.Random(1)

    def boxes(n: int) -> list[tuple]:
        out = []
        for i in range(n):
            x, y = rng.choice([rng.uniform(-200, 700), 64.0, 0.0]), rng.uniform(-100, 800)
            w, h = (0.0, 0.0) if i % 11 == 0 else (1e7, 1e6) if i % 13 == 0 else (rng.uniform(0, 150), rng.uniform(0, 40))
            out.append((i % 2, i, (x, y, x + w, y + h)))
        return [*out, (0, n, None), (0, n + 1, (5.0, 5.0, 1.0, 9.0)), (0, n + 2, (1.0, None, 4.0, 5.0)), (1, n + 3, (float("nan"), 0.0, 1.0, 1.0)), (1, n + 4, (0.0, 0.0, float("inf"), 1.0))]

    left, right = boxes(120), boxes(90)
    a, b = spark.createDataFrame(left, f"page int, i int, a {BOX}"), spark.createDataFrame(right, f"page int, j int, b {BOX}")
    for axes, sides in (("xy", [(0, 2), (1, 3)]), ("x", [(0, 2)])):
        usable = lambda v, sides=sides: v is not None and all(v[k] is not None and abs(v[k]) < 1e15 for s in sides for k in s) and all(v[p] <= v[q] for p, q in sides)
        fits = lambda v, w, sides=sides: all(v[p] <= w[q] and w[p] <= v[q] for p, q in sides)
        expected = collections.Counter((p, i, j) for p, i, v in left for q, j, w in right if p == q and usable(v) and usable(w) and fits(v, w))
        assert collections.Counter(map(tuple, touching(a, b, ["page"], "a", "b", axes=axes).select("page", "i", "j").collect())) == expected
    assert touching(a.limit(0), b, ["page"], "a", "b").count() == 0


# ---------------------------------------------------------------- fusion


def key(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum() or c == "_")


def same(a: str, b: str) -> float:
    a, b = key(a), key(b)
    if not a or not b:
        return 0.0
    return min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()


def area(b: tuple | None) -> float:
    return 0.0 if b is None else max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def shared(a: tuple, b: tuple) -> float:
    return area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))


def hull(boxes: list[tuple]) -> tuple | None:
    return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None


def expected_fusion(block: tuple, lines: list[tuple], objects: list[tuple]) -> tuple:
    _, block_id, role, text, box = block
    text = text or ""
    box = box if box and box[2] > box[0] and box[3] > box[1] else None
    inside = box is not None and box[0] >= -2 and box[1] >= -2 and box[2] <= 614 and box[3] <= 794
    wide = inside and (box[0] - 3, box[1] - 3, box[2] + 3, box[3] + 3)
    here = sorted(((b[1], b[0], i), shared(b, wide) / area(b), t) for i, _, t, b in lines if shared(b, wide) / area(b) >= 0.45) if inside else []
    spatial = sum(x[1] for x in here) / len(here) if here else 0.0
    place = same(text, " ".join(x[2] for x in here)) if here and text else 0.0
    native = collections.defaultdict(list)
    for line in lines:
        native[line[1]].append(line)
    found = max(((same(text, " ".join(x[2] for x in own)), -n, own) for n, own in native.items()), default=(0.0, 0, [])) if text else (0.0, 0, [])
    recovery, own = (found[0], found[2]) if found[0] >= 0.55 else (0.0, [])
    near = hull([x[3] for x in own])
    overlap = shared(box, near) / (area(box) + area(near) - shared(box, near)) if box and near else 0.0
    held = [(max(shared(o, box) / area(o), shared(o, box) / area(box)), area(o), o) for _, o in objects if area(o)] if inside and role in ("figure_object", "table_object") else []
    obj = max((h for h in held if h[0] >= 0.35), default=(0, 0, None))[2]
    if not text and obj:
        status = "accepted_cross_checked_native_object"
    elif here:
        status = "unresolved_text_mismatch"
        if not text:
            status = "content_envelope_no_text_cross_check"
        elif own and recovery >= 0.65 and recovery - place >= 0.15 and overlap < 0.1:
            status = "rejected_used_native"
        elif place >= 0.45:
            status = "accepted_cross_checked"
        elif own and recovery - place >= 0.15:
            status = "rejected_used_native"
    else:
        status = "rejected_used_native" if own else "unresolved_no_native_match" if text else "unverifiable"
    used = status == "rejected_used_native"
    ids = [x[0] for x in own] if used else [x[0][2] for x in here] if status != "unresolved_text_mismatch" else []
    score = min(1.0, 0.55 * place + 0.45 * spatial)
    sure = recovery if used else max(score, 0.75 * spatial) if ids and not text else score
    final = "unmatched" if not ids else "matched" if sure >= 0.65 else "low_confidence"
    taken = hull([x[3] for x in lines if x[0] in ids])
    return block_id, status, final, round(sure, 6), round(recovery if used else place, 6), round(spatial, 6), tuple(ids), obj or taken or box


def page(rng: random.Random) -> tuple[list, list, list]:
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(30)]
    lines, blocks, objects, y = [], [], [], 30.0
    for n in range(9):
        own = []
        for _ in range(rng.randint(1, 3)):
            text = " ".join(rng.choice(words) for _ in range(5))
            own.append((len(lines), n, text, (70.0, y, 70.0 + 5 * len(text), y + 10)))
            lines.append(own[-1])
            y += 13
        y += 9
        text, box = " ".join(x[2] for x in own), hull([x[3] for x in own])
        at = lambda dx, dy, b=box: (b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy)
        typo = "".join("x" if rng.random() < 0.25 else c for c in text)
        text = rng.choice([text, text, typo, "", None, "zzzz yyyy wwww", text[: len(text) // 3], "--"])
        box = rng.choice([box, box, at(0, 35), at(0, 300), at(700, 0), at(0, 6), at(60, 0), None, (5.0, 5.0, 5.0, 9.0)])
        role = rng.choice(["paragraph", "figure_object", "table_object"])
        blocks.append((n, role, text, box))
        if box and rng.random() < 0.5:
            objects.append((n, tuple(v + rng.choice([-4.0, 2.0, 15.0]) for v in box[:2]) + tuple(v + 5 for v in box[2:])))
    return lines, blocks, objects


def test_fusion(spark):  # noqa: ANN001, ANN201
    rng = random.Random(8)
    pages = [page(rng) for _ in range(40)]
    span = ("F", 10.0, False, False, 5)
    lines = spark.createDataFrame([(p, (i, n, t, b, b[3] - 2, [span])) for p, (ls, _, _) in enumerate(pages) for i, n, t, b in ls], f"page int, line {LINE}")
    blocks = spark.createDataFrame([(p, *b) for p, (_, bs, _) in enumerate(pages) for b in bs], f"page int, block_id int, role string, text string, box {BOX}")
    objects = spark.createDataFrame([(p, *o) for p, (_, _, os) in enumerate(pages) for o in os], f"page int, object_id int, box {BOX}")
    sizes = spark.createDataFrame([(p, 612.0, 792.0) for p in range(40)], "page int, width double, height double")
    expected = {(p, b[0]): expected_fusion((p, *b), ls, os) for p, (ls, bs, os) in enumerate(pages) for b in bs}
    found = fuse_blocks(blocks, lines, objects, sizes, ["page"]).collect()
    assert len(found) == len(expected)
    ours = {(r["page"], r["block_id"]): (r["block_id"], r["box_status"], r["status"], round(r["confidence"], 6), round(r["text_score"], 6), round(r["spatial_score"], 6), tuple(r["line_ids"]), r["box"] and tuple(r["box"])) for r in found}
    assert ours == expected
    assert len({r["box_status"] for r in found}) == 7 and {r["status"] for r in found} == {"matched", "low_confidence", "unmatched"}
    assert {x for r in found for x in r["reasons"]} >= {"missing_or_invalid_box", "box_outside_page", "text_conflicts_with_box", "no_matching_text_at_box", "text_in_box_does_not_match", "no_reliable_text_match"}


def test_style_of_fused_lines(spark):  # noqa: ANN001, ANN201
    spans = [[("B", 12.0, True, False, 6)], [("A", 10.0, False, True, 5), ("A", 9.0, False, False, 0)], [("B", 10.0, False, False, 0)]]
    rows = [(1, (i, 1, "word", (0.0, 14.0 * i, 50.0, 14.0 * i + 10), 14.0 * i + 8 + (3 if i == 2 else 0), s)) for i, s in enumerate(spans)]
    blocks = spark.createDataFrame([(1, 1, "paragraph", "word word word", (0.0, 0.0, 50.0, 40.0))], f"page int, block_id int, role string, text string, box {BOX}")
    empty = spark.createDataFrame([], f"page int, object_id int, box {BOX}")
    one = fuse_blocks(blocks, spark.createDataFrame(rows, f"page int, line {LINE}"), empty, spark.createDataFrame([(1, 612.0, 792.0)], "page int, width double, height double"), ["page"]).first()
    assert (one["style"]["font"], one["style"]["size"], one["style"]["gap"]) == ("B", 10.0, 15.5)
    assert round(one["style"]["bold"], 6) == round(6 / 13, 6) and round(one["style"]["italic"], 6) == round(5 / 13, 6)


def test_unique_blocks_are_scaled(spark):  # noqa: ANN001, ANN201
    rows = [(1, 1, "text", "A b", (10.0, 20.0, 30.0, 40.0), 100.0, 200.0), (1, 2, "text", "a-B", (10.001, 20.0, 30.0, 40.0), 100.0, 200.0), (1, 3, "title", "A b", (10.0, 20.0, 30.0, 40.0), 100.0, 200.0), (1, 4, "text", "A b", (60.0, 80.0, 180.0, 160.0), None, None), (1, 5, "text", "other", None, 100.0, 200.0)]
    df = spark.createDataFrame(rows, f"page int, block_id int, kind string, text string, box {BOX}, source_width double, source_height double").withColumn("target_width", F.lit(600.0)).withColumn("target_height", F.lit(800.0))
    found = {r["block_id"]: r["box"] and tuple(r["box"]) for r in unique_blocks(df, ["page"]).collect()}
    assert found == {1: (60.0, 80.0, 180.0, 160.0), 3: (60.0, 80.0, 180.0, 160.0), 5: None, 2: (60.006, 80.0, 180.0, 160.0)}


# ---------------------------------------------------------------- runs of lines


def runs(text: str, lines: list[str], most: int, head: int, least: int, low: float, high: float):  # noqa: ANN201
    for start, first in enumerate(lines):
        if len(first) >= least and (text[:head] in first or first[:head] in text):
            joined = ""
            for end in range(start, min(start + most, len(lines))):
                joined += lines[end]
                if low <= len(joined) <= high:
                    yield start, end - start + 1, joined


def test_runs_of_lines(spark):  # noqa: ANN001, ANN201
    rng = random.Random(12)
    pages = []
    for _ in range(25):
        lines = ["".join(rng.choice("abcde") for _ in range(rng.choice([0, 3, 7, 8, 9, 14, 30]))) for _ in range(rng.randint(1, 70))]
        blocks = []
        for _ in range(6):
            i = rng.randrange(len(lines))
            text = "".join(lines[i : i + rng.randint(1, 6)])
            blocks.append(rng.choice([text, text[:-2], text + "zz", "".join("z" if rng.random() < 0.1 else c for c in text), text[3:], "x", "abc"]))
        pages.append((lines, blocks))
    ls = spark.createDataFrame([(p, i, t) for p, (a, _) in enumerate(pages) for i, t in enumerate(a)], "page int, at int, key string")
    bs = spark.createDataFrame([(p, i, t) for p, (_, b) in enumerate(pages) for i, t in enumerate(b)], "page int, block_id int, key string")
    holding, similar = {}, {}
    for p, (lines, blocks) in enumerate(pages):
        for b, text in enumerate(blocks):
            n = len(text)
            if n >= 3:
                found = [(-abs(n - len(j)), -s, -k) for s, k, j in runs(text, lines, 60, 8, 8, max(3, n // 5), n * 1.25 + 12) if text in j or j in text]
                holding |= {(p, b): (-max(found)[1], -max(found)[2], max(found)[0])} if found else {}
            if n >= 2:
                score = lambda j, text=text: max(difflib.SequenceMatcher(None, text, j, autojunk=False).ratio(), min(len(text), len(j)) / max(len(text), len(j)) if text in j or j in text else 0)
                found = [(score(j), -s, -k) for s, k, j in runs(text, lines, 45, 10, 0, max(2, n // 6), n * 1.18 + 24)]
                similar |= {(p, b): (-max(found)[1], -max(found)[2], round(max(found)[0], 4))} if found and max(found)[0] >= 0.78 else {}
    got = lambda df: {(r["page"], r["block_id"]): (r["first_line"], r["lines"], r["score"]) for r in df.collect()}
    assert len(holding) > 40 and got(holding_runs(bs, ls, ["page"])) == holding
    assert len(similar) > 60 and got(similar_runs(bs, ls, ["page"])) == similar


def test_runs_in_long_texts(spark):  # noqa: ANN001, ANN201
    """A start deep in a long text, beyond the first chunk of its runs of characters."""
    lines = [f"line number {i} of the page".replace(" ", "") for i in range(40)]
    text = "".join(lines)[5:]
    ls = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "page int, at int, key string")
    bs = spark.createDataFrame([(1, 1, text), (1, 2, "?" * 700 + lines[30])], "page int, block_id int, key string")
    assert {(r["block_id"], r["first_line"], r["lines"]) for r in holding_runs(bs, ls, ["page"]).collect()} == {(1, 0, 40)}


# ---------------------------------------------------------------- review units


def halved(unit: tuple, budget: int, most: int) -> list[tuple]:
    doc, parent, title, rules, pages = unit
    out = []

    def go(rules: list, pages: list, depth: int, note: str) -> None:
        size = 10 + sum(x[1] for x in rules) + sum(x[1] for x in pages)
        if rules and size > budget and depth < most and (len(rules) > 1 or len(pages) > 1):
            by_rules = len(rules) > 1
            half = len(rules if by_rules else pages) // 2
            kind = "rules" if by_rules else "refined"
            go(rules[:half] if by_rules else rules, pages if by_rules else pages[:half], depth + 1, f"{note} ({kind} 1/2)")
            go(rules[half:] if by_rules else rules, pages if by_rules else pages[half:], depth + 1, f"{note} ({kind} 2/2)")
            return
        status = "not_needed" if not rules else "within_budget" if size <= budget else "minimum_unit_exceeds_budget"
        out.append((doc, parent, title + note, tuple(r[0] for r in rules), pages[0][0] if pages else None, pages[-1][0] if pages else None, size, depth, status))

    go(sorted(rules), sorted(pages), 0, "")
    return out


def test_refined_units(spark):  # noqa: ANN001, ANN201
    rng = random.Random(2)
    units = [(d, u, f"unit {u}", [(f"r{k:02}", rng.randint(1, 90)) for k in rng.sample(range(60), rng.choice([0, 1, 2, 7, 30]))], [(k, rng.randint(1, 300)) for k in rng.sample(range(40), rng.choice([0, 1, 2, 9]))]) for d in range(12) for u in (1, 2, 3)]
    df = spark.createDataFrame(units, "doc_id int, unit int, title string, rules array<struct<id:string,tokens:bigint>>, pages array<struct<page:int,tokens:bigint>>")
    for most in (8, 2, 0):
        expected = [x for u in units for x in halved(u, 200, most)]
        found = refine_units(df, 200, base=10, most_depth=most).orderBy("doc_id", "unit").collect()
        assert [(r["doc_id"], r["parent"], r["title"], tuple(r["rule_ids"]), r["first_page"], r["last_page"], r["tokens"], r["depth"], r["status"]) for r in found] == expected
        assert [r["unit"] for r in found if r["doc_id"] == 3] == list(range(1, 1 + sum(r["doc_id"] == 3 for r in found)))
    assert {r["status"] for r in found} == {"not_needed", "within_budget", "minimum_unit_exceeds_budget"}


def test_planned_units(spark):  # noqa: ANN001, ANN201
    facts = [  # document 1: every kind; 2: no numbers, no abstract, no opening facts; 3: no pages
        (1, 0, 1, "title", "", "A title"), (1, 1, 1, "abstract", "", "What it does"), (1, 2, 1, "paragraph", "1 Introduction", "text"), (1, 3, 2, "paragraph", "", "follows the first"),
        (1, 4, 2, "paragraph", "2.1 Part", "see Table 1"), (1, 5, 3, "derived_captions", "2 Methods", "left out"), (1, 6, 3, "native_image_object", "2 Methods", None), (1, 7, 4, "paragraph", "References", "[1] A. Smith"),
        (1, 8, 5, "heading", None, "Appendix A"), (1, 9, 6, "paragraph", "2 Methods", "late"), (1, 10, None, "paragraph", "", "without a page"),
        (2, 0, 3, "paragraph", "9", "x"), (2, 1, 3, "paragraph", "9", "y"), (4, 0, 1, "author", "", "a"), (4, 1, 2, "paragraph", "", "b"), (4, 2, 5, "paragraph", "", "c"), (4, 3, 7, "paragraph", "", "d"), (3, 0, None, "title", "", "no page"),
    ]
    df = spark.createDataFrame([(d, p, d * 100 + p, *rest) for d, p, *rest in facts], "doc_id int, position int, evidence_id int, page int, role string, section string, quote string")
    found = [tuple(r) for r in plan_units(df).orderBy("doc_id", "unit").collect()]
    assert found == [
        (1, 1, "front_matter", "Front matter", 1, 1, 1, 100), (1, 2, "abstract", "Abstract", 1, 1, 1, 101), (1, 3, "body_section", "1 Introduction", 1, 1, 2, 102), (1, 4, "body_section", "2 Methods", 2, 3, 3, 103),
        (1, 5, "figure_table", "Figures and tables", 2, 3, 2, 104), (1, 6, "reference", "References", 4, 4, 1, 107), (1, 7, "appendix", "Appendix", 5, 6, 2, 108), (1, 8, "global", "Global layout", 1, 6, 11, 100),
        (2, 1, "front_matter", "Front matter", 3, 3, 2, 200), (2, 2, "abstract", "Abstract", 3, 3, 2, 200), (2, 3, "body_section", "Section 9", 3, 3, 2, 200), (2, 4, "global", "Global layout", 3, 3, 2, 200),
        (4, 1, "front_matter", "Front matter", 1, 1, 1, 400), (4, 2, "abstract", "Abstract", 1, 1, 1, 400), (4, 3, "body_section", "Body pages 2-5", 2, 5, 2, 401), (4, 4, "body_section", "Body pages 7-7", 7, 7, 1, 403), (4, 5, "global", "Global layout", 1, 7, 4, 400),
    ]
