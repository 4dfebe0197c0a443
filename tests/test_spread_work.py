"""Work that a small file begets is dealt to many tasks."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["J14_rule_allocation", "X11_recursive_values"])
def test_one_small_file_makes_many_tasks(spark, tmp_path, name):  # noqa: ANN001, ANN201
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS p_partkey, CAST(i % 50 AS INTEGER) AS p_size FROM range(400) t(i)) TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT i AS s_suppkey FROM range(20) t(i)) TO '{tmp_path}/supplier.parquet'")
    con.execute(f"COPY (SELECT i AS o_orderkey, 'F' AS o_orderstatus, '1-URGENT' AS o_orderpriority FROM range(400) t(i)) TO '{tmp_path}/orders.parquet'")
    for f in tmp_path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())
    used = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(used) < sum(used) / 2
