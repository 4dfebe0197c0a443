"""Queries over whole tables, against literals."""

from __future__ import annotations

import quirework.queries  # noqa: F401
from quirework.registry import QUERIES

LINES = ["Abstract", "Introduction", "Related work", "Data set", "Evaluation", "Analysis", "Ablation", "Our approach", "Future work", "Conclusion", "Bibliography", "Supplement", "plain data"]
ROLES = ["abstract", "introduction", "related_work", "dataset", "experiment", "result", "ablation", "method", "limitation", "conclusion", "reference", "appendix", "body"]


def documents(spark, path, texts):  # noqa: ANN001, ANN201
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")


def test_first_match_gives_all_roles(spark, tmp_path):  # noqa: ANN001, ANN201
    documents(spark, tmp_path, ["\n".join(LINES)])
    found = {r["block_no"]: r["role"] for r in QUERIES["F19_first_match"](spark, str(tmp_path)).collect()}
    assert [found[i] for i in range(len(ROLES))] == ROLES


def test_preview_of_links_and_images(spark, tmp_path):  # noqa: ANN001, ANN201
    documents(spark, tmp_path, ["# A [link](http://x) ![pic](y.png) end", "plain [1]", "no bracket"])
    found = {r["doc_id"]: r["preview"] for r in QUERIES["X35_markdown_preview"](spark, str(tmp_path)).collect()}
    assert found == {0: "A link end", 1: "plain [1]", 2: "no bracket"}
