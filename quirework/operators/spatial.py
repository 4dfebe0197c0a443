"""Joins of boxes by a grid: boxes meet in the cells they touch, not in whole pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import overlap
from .relational import settled

CELL = 64.0
MOST_CELLS = 256


def equal_boxes(df: DataFrame, keys: list[str], box: str, *aggregates: Column) -> DataFrame:
    """One row for each different ``box`` of a key. What boxes alone decide, as who meets whom, is then worked out
    once for all rows that share one, so a page crowded with copies makes no more pairs than one without."""
    return df.groupBy(*keys, box).agg(*aggregates)


def overlapped(some: DataFrame, rows: DataFrame, keys: list[str], box: str, own: str, cell: float = 3.0) -> DataFrame:
    """The rows of ``some`` (``keys``, ``own``, ``box``, maybe more) whose box shares an area with the box of a row
    of ``rows`` with another ``own``.

    Boxes that cover the same small cell overlap, so each looks first into the first cell that it covers whole.
    Only those who find nobody there meet their neighbours one by one: the more crowded a page, the fewer."""

    def homes(df: DataFrame) -> DataFrame:
        at = {f"_home_{x}": F.ceil(F.col(box)[f"{x}0"] / cell) for x in "xy"}
        covered = [(at[f"_home_{x}"] + 1) * cell <= F.col(box)[f"{x}1"] for x in "xy"]
        # a box whose sides are no finite numbers has no home
        fine = covered[0] & covered[1]
        for side in ("x0", "y0", "x1", "y1"):
            fine = fine & (F.abs(F.col(box)[side]) < 1e15)
        return df.withColumns({name: F.when(fine, c) for name, c in at.items()})

    at = ["_home_x", "_home_y"]
    full = homes(rows).filter(F.col("_home_x").isNotNull()).groupBy(*keys, *at).agg(F.min(own).alias("_least"), F.max(own).alias("_most"))
    met = F.coalesce((F.col("_least") != F.col(own)) | (F.col("_most") != F.col(own)), F.lit(False))
    seen = homes(some).join(full, [*keys, *at], "left").withColumn("_met", met)
    alone = seen.filter("NOT _met").select(*some.columns)
    other = rows.select(*keys, F.col(own).alias("_other"), F.col(box).alias("_near"))
    pairs = touching(alone, other, keys, box, "_near").filter((F.col(own) != F.col("_other")) & (overlap(F.col(box), F.col("_near")) > 0))
    return seen.filter("_met").select(*some.columns).unionByName(alone.join(pairs.select(*keys, own, box), [*keys, own, box], "left_semi").select(*some.columns))


def _span(box: Column, low: str, high: str, cell: float) -> tuple[Column, Column]:
    return tuple(F.floor(box[c] / cell).cast("long") for c in (low, high))


def touching(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, cell: float | dict[str, float] = CELL, axes: str = "xy", most_cells: int = MOST_CELLS) -> DataFrame:
    """Pairs of rows equal in ``keys`` whose boxes, struct columns ``a`` of ``left`` and ``b`` of ``right``, share
    a point; with ``axes`` 'x' or 'y' their projections do. The sides must not share other column names.

    Each box goes to the cells it touches, and a pair is kept in the lowest cell the two share, so it comes
    once. A box that touches more than ``most_cells`` cells meets the others of its key instead: it covers so
    much that most of them are its pairs anyway. ``cell`` may name a size for each axis. Rows without a box, with
    a part of it null or not finite, or turned inside out meet nothing.
    """

    sizes = cell if isinstance(cell, dict) else dict.fromkeys(axes, cell)

    def usable(box: str) -> Column:
        sides = [F.col(box)[f"{x}{i}"].cast("double") for x in axes for i in (0, 1)]
        fine = F.lit(True)
        for s in sides:
            fine = fine & s.isNotNull() & (F.abs(s) < 1e15)
        for low, high in zip(sides[::2], sides[1::2], strict=True):
            fine = fine & (low <= high)
        return fine

    def prepared(df: DataFrame, box: str) -> DataFrame:
        df = settled(df.withColumnRenamed(box, "_given"), **{box: F.col("_given")}).drop("_given")
        n: Column = F.lit(1)
        for x in axes:
            lo, hi = _span(F.col(box), f"{x}0", f"{x}1", sizes[x])
            n = n * (hi - lo + 1).cast("double")
        return df.filter(F.coalesce(usable(box), F.lit(False))).withColumn(f"_wide_{box}", n > most_cells)

    def dealt(df: DataFrame, box: str) -> DataFrame:
        out = df.filter(~F.col(f"_wide_{box}"))
        for x in axes:
            lo, hi = _span(F.col(box), f"{x}0", f"{x}1", sizes[x])
            out = out.withColumn(f"_cell_{x}", F.explode(F.sequence(lo, hi)))
        return out

    ls, rs = prepared(left, a), prepared(right, b)
    share, first = F.lit(True), F.lit(True)
    for x in axes:
        share = share & (F.col(a)[f"{x}0"] <= F.col(b)[f"{x}1"]) & (F.col(b)[f"{x}0"] <= F.col(a)[f"{x}1"])
        first = first & (F.col(f"_cell_{x}") == F.floor(F.greatest(F.col(a)[f"{x}0"], F.col(b)[f"{x}0"]) / sizes[x]))
    cells = [f"_cell_{x}" for x in axes]
    near = dealt(ls, a).join(dealt(rs, b), [*keys, *cells]).filter(share & first).drop(*cells)
    wide = ls.filter(f"_wide_{a}").join(rs, keys).filter(share).unionByName(ls.filter(f"NOT _wide_{a}").join(rs.filter(f"_wide_{b}"), keys).filter(share))
    return near.unionByName(wide).drop(f"_wide_{a}", f"_wide_{b}")
