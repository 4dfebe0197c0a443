"""Facts of all pages and nulls after all values: no page range and no limit."""

from __future__ import annotations

import quirework.queries  # noqa: F401
from quirework.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_review_facts_of_all_pages(spark):  # noqa: ANN001, ANN201
    found = QUERIES["P11_review_facts"](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count() + spark.read.parquet(f"{SF}/part.parquet").count()
    assert len(found) == n and max(r["page"] for r in found) > 3


def test_nulls_come_last(spark):  # noqa: ANN001, ANN201
    toxic = [r["toxic"] for r in QUERIES["T04_nulls_last"](spark, SF).collect()]
    assert len(toxic) == spark.read.parquet(f"{SF}/documents.parquet").count() and None in toxic
    assert None not in toxic[: toxic.index(None)] and set(toxic[toxic.index(None) :]) == {None}
