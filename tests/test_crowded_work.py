"""What box joins make doesn't grow with copies of a box."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import spatial
from quirework.queries import layout, rest


def test_copies_of_objects_make_no_more_pairs(spark, tmp_path, monkeypatch):  # noqa: ANN001, ANN201
    from test_larger_tables import crowd

    made: list[int] = []

    def counted(*given, **named):  # noqa: ANN002, ANN003, ANN202
        found = spatial.touching(*given, **named)
        made.append(found.count())
        return found

    monkeypatch.setattr(layout, "touching", counted)
    monkeypatch.setattr(rest, "touching", counted, raising=False)
    sizes = []
    for copies in (40, 400):
        made.clear()
        folder = tmp_path / str(copies)
        folder.mkdir()
        crowd(folder, copies, 1000)
        for f in (layout.j07, layout.j08, layout.j11, layout.x15, rest.j09):
            f(spark, str(folder))
        sizes.append(list(made))
    assert sizes[0] == sizes[1] and len(sizes[0]) == 5


@pytest.mark.parametrize("side", [30.0, 300.0])
def test_overlapped_finds_what_all_pairs_find(spark, side):  # noqa: ANN001, ANN201
    rng = random.Random(4)
    rows = [(rng.randint(1, 2), i if rng.random() < 0.9 else i - 1, x := rng.uniform(0, side), y := rng.uniform(0, side), x + rng.choice([0.0, 1.5, 8.0, 40.0]), y + rng.choice([2.0, 7.0, 9.0])) for i in range(300)]
    rows += [(1, 900, 1.0, 1.0, None, 5.0), (1, 901, float("nan"), 1.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double").select("page", "id", F.struct("x0", "y0", "x1", "y1").alias("b"))
    got = sorted(tuple(r) for r in spatial.overlapped(df.filter("id % 3 = 0"), df, ["page"], "b", "id").select("page", "id").collect())
    meet = lambda a, b: a[0] == b[0] and a[1] != b[1] and min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3])
    whole = rows[:300]
    assert got == sorted((a[0], a[1]) for a in whole if a[1] % 3 == 0 and any(meet(a, b) for b in whole)) and got
