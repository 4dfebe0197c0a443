"""Queries that list all pairs write them in an order that Parquet stores in little."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry


def pairs(folder, rules: int, units: int, lines: int) -> None:  # noqa: ANN001
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i // 10 * 50 + i % 10 AS p_partkey, CAST(i // 10 % 50 + 1 AS INTEGER) AS p_size FROM range({rules}) t(i)) TO '{folder}/part.parquet'")
    con.execute(f"COPY (SELECT i AS s_suppkey FROM range({units}) t(i)) TO '{folder}/supplier.parquet'")
    con.execute(f"""COPY (SELECT i // 10 * 50 + i % 10 AS l_orderkey, 1 AS l_linenumber, i * 37 % 500 AS l_partkey, 13 * (i % 10) // 7 AS l_suppkey, CAST(i % 50 + 1 AS DOUBLE) AS l_quantity, 0.02::DOUBLE AS l_tax, 'A' AS l_returnflag
      FROM range({lines}) t(i)) TO '{folder}/lineitem.parquet'""")


@pytest.mark.parametrize(("name", "sizes", "most"), [("J14_rule_allocation", (3500, 4000, 1), 0.5)])
def test_bytes_a_pair(spark, tmp_path, name, sizes, most):  # noqa: ANN001, ANN201
    pairs(tmp_path, *sizes)
    out = tmp_path / "out"
    entry.queries()[name](spark, str(tmp_path)).write.parquet(str(out))
    con = duckdb.connect()
    for f in tmp_path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    con.execute(f"CREATE TABLE want AS {entry.oracle_sql()[name]}")
    con.execute(f"CREATE TABLE got AS SELECT {', '.join(d[0] for d in con.execute('DESCRIBE want').fetchall())} FROM read_parquet('{out}/*.parquet')")
    assert con.execute("SELECT count(*) FROM (FROM want EXCEPT ALL FROM got)").fetchall() == [(0,)] == con.execute("SELECT count(*) FROM (FROM got EXCEPT ALL FROM want)").fetchall()
    rows = con.execute("SELECT count(*) FROM got").fetchall()[0][0]
    size = sum(f.stat().st_size for f in out.glob("*.parquet"))
    assert rows > 1_000_000 and size < most * rows


def test_lines_of_a_box_follow_one_another(spark, tmp_path):  # noqa: ANN001, ANN201
    """So that its objects' ids repeat from line to line."""
    pairs(tmp_path, 500, 1, 20_000)
    objects = [r["object_id"] for r in entry.queries()["X15_bbox_kit"](spark, str(tmp_path)).collect()]
    boxes = [(i % 50, (i // 50) % 50) for i in objects]
    changes = sum(a != b for a, b in zip(boxes, boxes[1:], strict=False))
    assert len(boxes) > 5000 and changes < len(set(boxes))


def test_null_ids_stay(spark):  # noqa: ANN001, ANN201
    from quirework.operators.relational import bundled

    rows = [(1, k) for k in (3, None, 1, 3, 2)] + [(2, 9)]
    found = bundled(spark.createDataFrame(rows, "k int, id long"), ["k"], "id", 2).collect()
    assert sorted((r["k"], [x["id"] for x in r["id"]]) for r in found if r["k"] == 2) == [(2, [9])]
    assert sorted(len(r["id"]) for r in found) == [1, 1, 2, 2] and sorted(str(x["id"]) for r in found for x in r["id"]) == ["1", "2", "3", "3", "9", "None"]
