"""Layout JSON of a page parser, in either of its two shapes, as one row a block.

A page tree holds `pdf_info`: pages with `page_idx`, `page_size` and blocks (`para_blocks`, or else `preproc_blocks`)
that may hold `blocks` again; a flat list holds blocks with a `page_idx` each. Texts are walked in Arrow batches
and every block becomes a row at once, so nesting has no limit; roles, sizes and repeats are settled by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.fusion import unique_blocks
from ..shipping import ship

# Kinds and roles that results depend on.
KINDS = ["title", "text", "ref_text", "image", "chart", "table", "image_caption", "chart_caption", "table_caption", "equation", "interline_equation", "code", "page_number", "header", "page_footnote"]
FIGURE_CAPTION, TABLE_CAPTION = r"(?i)^(?:Figure|Fig\.)\s*\d+\s*[.:]", r"(?i)^Table\s*\d+\s*[.:]"
ROLES = [
    (["image_caption", "chart_caption"], "figure_caption"), (["table_caption"], "table_caption"), (["ref_text"], "reference_entry"), (["image", "chart"], "figure_object"), (["table"], "table_object"),
    (["equation", "interline_equation"], "display_formula"), (["page_number"], "page_number"), (["header"], "header"), (["page_footnote"], "page_footnote"),
]

_BOX = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
_ROW = pa.struct([("page", pa.int64()), ("path", pa.string()), ("parent", pa.string()), ("kind", pa.string()), ("level", pa.int64()), ("text", pa.string()), ("box", _BOX), ("source_width", pa.float64()), ("source_height", pa.float64())])
_DDL = "array<struct<page:bigint,path:string,parent:string,kind:string,level:bigint,text:string,box:struct<x0:double,y0:double,x1:double,y1:double>,source_width:double,source_height:double>>"


def _number(value: Any) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def _box(value: Any) -> dict[str, float] | None:
    if not isinstance(value, list) or len(value) != 4 or not all(map(_number, value)) or value[2] <= value[0] or value[3] <= value[1]:
        return None
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, value), strict=True))


def _text(node: dict[str, Any]) -> str:
    own = node.get("text")
    if isinstance(own, str) and own.strip():
        return own
    among = lambda value, key: (x for x in (value.get(key) if isinstance(value.get(key), list) else []) if isinstance(x, dict))
    return " ".join(s["content"] for line in among(node, "lines") for s in among(line, "spans") if isinstance(s.get("content"), str))


def _places(value: Any) -> Iterator[tuple[int, str, dict[str, Any], tuple[float, float] | None]]:
    """(page, path, node, page size) of the outermost blocks."""
    if isinstance(value, list):
        for i, node in enumerate(value):
            if isinstance(node, dict):
                yield int(node.get("page_idx") or 0) + 1, str(i), node, None
    elif isinstance(value, dict) and isinstance(value.get("pdf_info"), list):
        for page in value["pdf_info"]:
            if isinstance(page, dict):
                size = page.get("page_size")
                sized = (float(size[0]), float(size[1])) if isinstance(size, list) and len(size) == 2 and all(map(_number, size)) else None
                for i, node in enumerate(page.get("para_blocks") or page.get("preproc_blocks") or []):
                    if isinstance(node, dict):
                        yield int(page.get("page_idx") or 0) + 1, str(i), node, sized


def blocks_in(text: str | None) -> list[dict[str, Any]] | None:
    """Blocks of a layout, children after their parent; null for what is neither of the two shapes. A block of an
    unknown kind counts for nothing, its children included."""
    try:
        value = json.loads(text) if text else None
    except ValueError:
        return None
    if not isinstance(value, list) and not (isinstance(value, dict) and isinstance(value.get("pdf_info"), list)):
        return None
    out = []
    for page, path, node, size in _places(value):
        stack = [(path, None, node)]
        while stack:
            at, parent, node = stack.pop()
            kind = node.get("type")
            if kind not in KINDS:
                continue
            level = node.get("level", node.get("text_level"))
            width, height = size or (None, None)
            out.append({"page": page, "path": at, "parent": parent, "kind": kind, "level": int(level) if _number(level) else None, "text": _text(node), "box": _box(node.get("bbox")), "source_width": width, "source_height": height})
            inner = node.get("blocks")
            stack += [(f"{at}.{i}", at, x) for i, x in reversed(list(enumerate(inner if isinstance(inner, list) else []))) if isinstance(x, dict)]
    return out


def semantic_role(kind: Column, text: Column, level: Column, page: Column) -> Column:
    role = F.when(text.rlike(FIGURE_CAPTION), "figure_caption").when(text.rlike(TABLE_CAPTION), "table_caption").when(kind == "title", F.when((page == 1) & (level == 1), "document_title").otherwise("section_heading"))
    for kinds, name in ROLES:
        role = role.when(kind.isin(kinds), name)
    return role.otherwise("paragraph")


def layout_blocks(layouts: DataFrame, pages: DataFrame) -> DataFrame:
    """``layouts``: doc_id, layout (JSON text). ``pages``: doc_id, page, width, height of the native pages.

    doc_id, page, block_id, parent, kind, role, level, text, box: boxes in the native page's measure, repeats left
    out. A layout in neither shape raises: its document would be lost without a word."""
    ship(layouts.sparkSession)
    walk = F.arrow_udf(lambda texts: pa.array([blocks_in(t) for t in texts.to_pylist()], pa.list_(_ROW)), _DDL)
    parsed = layouts.select("doc_id", walk("layout").alias("_blocks"))
    known = F.coalesce("_blocks", F.raise_error(F.concat(F.lit("no layout: document "), F.col("doc_id").cast("string"))).cast(_DDL))
    rows = parsed.select("doc_id", F.explode(known).alias("b")).select("doc_id", "b.*")
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.replace(X.nfkc(F.col("text")), F.lit("­"), F.lit("")), r"(?U)(?<=\w)-\s+(?=\w)", ""), r"(?U)\s+", " "))
    sized = rows.withColumn("text", clean).join(pages.select("doc_id", "page", F.col("width").alias("target_width"), F.col("height").alias("target_height")), ["doc_id", "page"], "left")
    named = sized.withColumn("role", semantic_role(F.col("kind"), F.col("text"), F.col("level"), F.col("page"))).withColumn("_order", F.transform(F.split("path", r"\."), lambda p: p.cast("int")))
    named = named.withColumn("block_id", F.struct("_order", F.concat_ws("-", F.concat(F.lit("p"), "page"), F.replace("path", F.lit("."), F.lit("-")), "kind").alias("id")))
    found = unique_blocks(named, ["doc_id", "page"])
    return found.select("doc_id", "page", F.col("block_id.id").alias("block_id"), "parent", "kind", "role", "level", "text", "box")
