"""Operators that depend on the order of rows within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def linked(df: DataFrame, group: list[str], order: list[Column], key: str) -> DataFrame:
    """Adds the key before and after in the group's order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def as_of(df: DataFrame, group: list[str], order: list[Column], holds: Column, value: Column, name: str) -> DataFrame:
    """The latest ``value`` of a row where ``holds``, at or before each row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(holds, value), ignorenulls=True).over(w))


def merge_continuations(df: DataFrame, group: list[str], order: str, starts: Column, text: str) -> DataFrame:
    """Rows that don't start an entry are added, after a blank, to the one before; the first row starts one."""
    w = Window.partitionBy(*group).orderBy(order)
    first = F.row_number().over(w) == 1
    entry = df.withColumn("_start", (starts | first).cast("int")).withColumn("entry", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return entry.groupBy(*group, "entry").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias(text), F.count("*").alias("rows"))


def pack_tokens(df: DataFrame, group: list[str], order: str, tokens: str, target: int, most: int) -> DataFrame:
    """Greedy packs of a group's rows: closed before passing ``most`` and on reaching ``target``; a short
    last pack joins the one before if both fit. One fold over a group's (narrow) rows, in the JVM."""
    item = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("n"))))
    zero = F.struct(F.array().cast("array<struct<first:bigint,last:bigint,n:bigint>>").alias("done"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))

    def closed(a: Column) -> Column:
        return F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["last"].alias("last"), a["n"].alias("n"))))

    def state(done: Column, first: Column, last: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), first.alias("first"), last.alias("last"), n.alias("n"))

    def step(a: Column, x: Column) -> Column:
        o = x["o"].cast("bigint")
        full = (a["n"] > 0) & (a["n"] + x["n"] > most)
        opened = F.when(full, state(closed(a), o, o, x["n"])).otherwise(state(a["done"], F.coalesce(a["first"], o), o, a["n"] + x["n"]))
        none = F.lit(None).cast("bigint")
        return F.when(opened["n"] >= target, state(closed(opened), none, none, F.lit(0).cast("bigint"))).otherwise(opened)

    def finish(a: Column) -> Column:
        packs = F.when(a["n"] > 0, closed(a)).otherwise(a["done"])
        size = F.size(packs)
        last, before = F.get(packs, size - 1), F.get(packs, size - 2)
        joined = F.concat(F.slice(packs, F.lit(1), F.greatest(size - 2, F.lit(0))), F.array(F.struct(before["first"].alias("first"), last["last"].alias("last"), (before["n"] + last["n"]).alias("n"))))
        return F.when((size > 1) & (last["n"] < target) & (before["n"] + last["n"] <= most), joined).otherwise(packs)

    packed = df.groupBy(*group).agg(F.aggregate(item, zero, step, finish).alias("packs"))
    return packed.select(*group, F.posexplode("packs").alias("pack", "p")).select(*group, "pack", F.col("p.first").alias("first"), F.col("p.last").alias("last"), F.col("p.n").alias("tokens"))


def budget_prefix(df: DataFrame, group: list[str], order: list[Column], size: Column, items: int, each: int, total: int) -> DataFrame:
    """The first ``items`` rows, cut to ``each`` characters, until ``total``; the last is cut to what is left."""
    w = Window.partitionBy(*group).orderBy(*order)
    cut = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= items).withColumn("_size", F.least(size, F.lit(each)))
    before = F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_before", before).filter(F.col("_before") < total).withColumn("taken", F.least(F.col("_size"), total - F.col("_before"))).drop("_n", "_size", "_before")


def visual_lines(df: DataFrame, group: list[str], near: float = 1.0) -> DataFrame:
    """Fragments (text, box, baseline; the box's bottom where that is null) put together to the lines one sees: a
    fragment joins a line if its baseline is within ``near`` of the line's first one.

    Fragments further than ``near`` apart from their neighbours can't share a line, so each stretch without
    such a gap is folded by itself. Adds ``line`` (from 1), baseline (median), box, text (by x0), fragments."""
    base = F.coalesce(F.col("baseline"), F.col("box.y1"))
    order = Window.partitionBy(*group).orderBy("_base", "_x", "_text")
    # dealt anew, as fragments are often cut from fewer rows: tasks sized by those would sort many times as much
    placed = df.select(*group, base.alias("_base"), F.col("box.x0").alias("_x"), F.col("text").alias("_text"), "box").repartition(*group)
    apart = F.col("_base") - F.lag("_base").over(order) > near
    stretches = placed.withColumn("_stretch", F.sum(F.when(apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    items = F.array_sort(F.collect_list(F.struct(F.col("_base").alias("b"), F.col("_x").alias("x"), F.col("_text").alias("t"), "box")))
    fragment = f"array<struct<b:double,x:double,t:string,box:{df.schema['box'].dataType.simpleString()}>>"
    last = lambda a: F.get(a, F.size(a) - 1)
    joins = lambda a, f: (F.size(a) > 0) & (F.abs(f["b"] - F.get(last(a), F.lit(0))["b"]) <= near)
    fold = F.aggregate(items.cast(fragment), F.array().cast(f"array<{fragment}>"), lambda a, f: F.when(joins(a, f), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(last(a), F.array(f))))).otherwise(F.concat(a, F.array(F.array(f)))))
    lines = stretches.groupBy(*group, "_stretch").agg(fold.alias("_lines")).select(*group, "_stretch", F.posexplode("_lines").alias("_at", "_f"))
    by_x = F.array_sort(F.transform("_f", lambda f: F.struct(f["x"].alias("x"), f["b"].alias("b"), f["t"].alias("t"))))
    bases, n = F.transform("_f", lambda f: f["b"]), F.size("_f")
    median = (F.get(bases, F.floor((n - 1) / 2).cast("int")) + F.get(bases, F.floor(n / 2).cast("int"))) / 2
    box = F.struct(*(f(F.col(f"_f.box.{c}")).alias(c) for c, f in (("x0", F.array_min), ("y0", F.array_min), ("x1", F.array_max), ("y1", F.array_max))))
    number = F.row_number().over(Window.partitionBy(*group).orderBy("_stretch", "_at"))
    return lines.select(*group, number.alias("line"), median.alias("baseline"), box.alias("box"), F.array_join(F.transform(by_x, lambda f: f["t"]), " ").alias("text"), n.alias("fragments"))
