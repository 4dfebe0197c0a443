"""Percentiles without a task that reads a whole group."""

from __future__ import annotations

import math

from quirework.operators import aggregates as A


def test_percentiles_equal_those_of_sorted_lists(spark):  # noqa: ANN001, ANN201
    groups = {"a": [float(i * 37 % 1009) for i in range(30_000)], "b": [3.5], "c": [5.0] * 9000 + [float(i) for i in range(9000)], None: [2.0, 1.0], "d": []}
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    linear = {r["k"]: r for r in A.linear_percentiles(df, ["k"], "v", shares).collect()}
    ranked = {r["k"]: r for r in A.ranked_percentiles(df, ["k"], "v", shares).collect()}
    assert set(linear) == set(groups) and set(ranked) == set(groups) - {"d"}
    for k, vs in groups.items():
        vs = sorted(vs)
        for name, p in shares.items():
            if not vs:
                assert linear[k][name] is None
                continue
            at = (len(vs) - 1) * p
            lo, hi = vs[math.floor(at)], vs[math.ceil(at)]
            assert math.isclose(linear[k][name], lo + (hi - lo) * (at - math.floor(at)), abs_tol=1e-9)
            assert ranked[k][name] == vs[max(1, min(len(vs), math.floor(len(vs) * p + 0.9999))) - 1]


def test_only_values_near_the_place_are_sorted(spark):  # noqa: ANN001, ANN201
    df = spark.range(200_000).selectExpr("0 AS k", "double(id * 7919 % 200003) AS v")
    plan = A.linear_percentiles(df, ["k"], "v", {"p": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in plan and "percentile_approx" in plan
