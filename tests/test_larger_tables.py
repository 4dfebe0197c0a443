"""Queries against their SQL on tables made so that what larger ones hold occurs: openings like an appendix's, crowded pages."""

from __future__ import annotations

import collections

import duckdb
import pytest

import __spark_entry__ as entry


def same_as_sql(spark, folder, name: str) -> int:  # noqa: ANN001
    """Compares a query with its SQL as multisets of rows; returns their number."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = collections.Counter(found.fetchall())
    df = entry.queries()[name](spark, str(folder))
    assert sorted(df.columns) == sorted(columns)
    got = collections.Counter(tuple(r) for r in df.select(*columns).collect())
    assert got == want
    return sum(want.values())


@pytest.mark.parametrize("name", ["R07_review_units", "R07_unit_members", "R08_refined_units"])
def test_titles_that_read_like_an_appendix(spark, tmp_path, name):  # noqa: ANN001, ANN201
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS doc_id, CASE i % 3 WHEN 0 THEN 'Appendix of names' WHEN 1 THEN 'A. Smith' ELSE 'plain' END || chr(10) || 'one' || chr(10) || 'two figure' || chr(10) || 'three' AS text,
      'en' AS lang, 's' AS source, 30 AS n_chars FROM range(12) t(i)) TO '{tmp_path}/documents.parquet'""")
    con.execute(f"COPY (SELECT i AS p_partkey, i % 50 + 1 AS p_size, 'Brand#' || i % 3 AS p_brand FROM range(30) t(i)) TO '{tmp_path}/part.parquet'")
    assert same_as_sql(spark, tmp_path, name) > 0


CROWDED = ["J07_spatial_fusion", "J08_native_object_match", "J09_span_to_block", "J11_caption_pairing", "J24_overlapping_neighbours", "X15_bbox_kit"]


def crowd(folder, copies: int, apart: int) -> None:  # noqa: ANN001
    """Few lines and many objects that share their boxes, ``apart`` lines to a copy."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i * 50 + 7 AS p_partkey, i % 4 + 1 AS p_size FROM range({copies}) t(i)) TO '{folder}/part.parquet'")
    con.execute(f"""COPY (SELECT i AS l_orderkey, 1 AS l_linenumber, i * 37 % 90 AS l_partkey, i * 7 % 41 AS l_suppkey, CAST(i // 50 % 50 + 1 AS DOUBLE) AS l_quantity, 0.02::DOUBLE AS l_tax, 'A' AS l_returnflag
      FROM range({apart}) t(i)) TO '{folder}/lineitem.parquet'""")


@pytest.mark.parametrize("name", CROWDED)
def test_crowded_pages(spark, tmp_path, name):  # noqa: ANN001, ANN201
    crowd(tmp_path, 40, 3000)
    assert same_as_sql(spark, tmp_path, name) > 0
