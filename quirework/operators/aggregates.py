"""Statistics that layout and evaluation rest on, with their ties settled."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_rank(value: Column, n: Column, p: float) -> Column:
    """Element of ascending ``value`` (an array of n) at int(n p + 0.9999) - 1, clamped; 0 when empty."""
    at = F.greatest(F.lit(0), F.least(n - 1, F.floor(n * p + 0.9999) - 1)).cast("int")
    return F.when(n > 0, F.get(value, at)).otherwise(F.lit(0))


#: Rank error of the sketch is one part in SKETCH; bounds lie MARGIN such parts from the rank wanted.
SKETCH, MARGIN = 4000, 4


def _at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """keys, ``_n`` (values that aren't null), and for each name the ascending value at the rank (from 0) that
    follows from ``_n``. ``ranks``: name -> (share near which the rank lies, rank).

    A sketch bounds each wanted value; what lies below the bounds is counted and only the few values inside them
    are sorted, so no task reads a whole large group. Should a bound be wrong, the query fails."""
    near = [min(1.0, max(0.0, p + side * MARGIN / SKETCH)) for p, _ in ranks.values() for side in (-1, 1)]
    bounds = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.percentile_approx(value, F.array(*map(F.lit, near)), F.lit(SKETCH)).alias("_bounds"))
    named = [F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
    same = reduce(lambda x, y: x & y, (df[k].eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)))
    held = df.filter(F.col(value).isNotNull()).join(F.broadcast(bounds.select(*named, "_n", "_bounds")), same)
    bound = lambda i: F.when(F.col("_n") >= SKETCH * MARGIN, F.get("_bounds", F.lit(i)))  # noqa: E731  else a rank more is more than the margin
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank"), bound(2 * i).alias("lo"), bound(2 * i + 1).alias("hi")) for i, (name, (_, rank)) in enumerate(ranks.items())])
    reached = F.filter(wanted, lambda w: w["hi"].isNull() | (F.col(value) <= w["hi"]))
    each = held.select(*keys, F.col(value).alias("_v"), F.explode(reached).alias("w"))
    per = each.groupBy(*keys, "w.name", "w.rank", F.when(F.col("w.lo").isNull() | (F.col("_v") >= F.col("w.lo")), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    run = F.sum("_c").over(Window.partitionBy(*keys, "name").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    hit = per.withColumn("_run", run).filter((F.col("_run") > F.col("rank")) & (F.col("_run") - F.col("_c") <= F.col("rank")))
    found = hit.groupBy(*named).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
    out = bounds.join(found, reduce(lambda x, y: x & y, (bounds[k].eqNullSafe(found[f"_key_{i}"]) for i, k in enumerate(keys))), "left")
    kind = df.schema[value].dataType
    sure = lambda name: F.when((F.col("_n") > 0) & F.col(name).isNull(), F.raise_error(F.lit("a sketch's bound was wrong")).cast(kind)).otherwise(F.col(name)).alias(name)
    return out.select(*[bounds[k] for k in keys], "_n", *map(sure, ranks))


def ranked_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group that has a value."""
    rank = lambda p: lambda n: F.greatest(F.lit(1), F.least(n, F.floor(n * p + 0.9999))) - 1
    return _at_ranks(df, keys, value, {name: (p, rank(p)) for name, p in shares.items()}).filter("_n > 0").drop("_n")


def linear_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles of each group, linear between the two values next to the place; null without any value."""
    place = lambda p: lambda n: (n - 1) * F.lit(p)
    ranks = {}
    for name, p in shares.items():
        ranks[f"_lo_{name}"] = p, lambda n, at=place(p): F.floor(at(n))
        ranks[f"_hi_{name}"] = p, lambda n, at=place(p): F.ceil(at(n))
    found = _at_ranks(df, keys, value, ranks)

    def between(name: str, p: float) -> Column:
        at, lo, hi = place(p)(F.col("_n")), F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        return F.when((F.floor(at) == F.ceil(at)) | (lo == hi), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name)

    return found.select(*keys, *[between(name, p) for name, p in shares.items()])


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """First value, ascending, whose cumulative weight reaches half; weights count 1 at least."""
    per = df.groupBy(*keys, value).agg(F.sum(F.greatest(F.col(weight), F.lit(1))).alias("_w"))
    run = F.sum("_w").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("_w").over(Window.partitionBy(*keys))
    return per.withColumn("_run", run).withColumn("_all", whole).filter(F.col("_run") * 2 >= F.col("_all")).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def binned_mode(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Median of the fullest bin of half-even rounded value / width; less spread, then the lower bin wins."""
    bins = df.withColumn("_bin", F.bround(F.col(value) / width)).groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), F.round(F.stddev_pop(value), 9).alias("_sd"), F.median(value).alias("binned_mode"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), F.asc("_sd"), F.asc("_bin"))
    return bins.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, "binned_mode", F.col("_n").alias("members"))


def rounded_mode(df: DataFrame, keys: list[str], value: str, digits: int = 1) -> DataFrame:
    """Commonest rounded value, the smallest on a tie."""
    per = df.groupBy(*keys, F.bround(value, digits).alias("mode")).agg(F.count("*").alias("_n"))
    return per.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "mode"))).filter("_r = 1").select(*keys, "mode")


def dominant(df: DataFrame, keys: list[str], name: str, weight: str) -> DataFrame:
    """The name of most total weight, the first by name on a tie."""
    per = df.groupBy(*keys, name).agg(F.sum(weight).alias("weight"))
    return per.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), name))).filter("_r = 1").drop("_r")


def consolidate(findings: DataFrame) -> DataFrame:
    """One verdict a rule: the most severe verdict; severity only among rows with it; the first text by
    unit; evidence of these rows, distinct; complete only if all of them are."""
    verdicts = ["not_applicable", "unverifiable", "compliant", "non_compliant"]
    severities = ["info", "low", "medium", "high"]
    rank = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    ranked = findings.withColumn("_v", rank("result", verdicts)).withColumn("_s", rank("severity", severities))
    top = F.max("_v").over(Window.partitionBy("rule_id"))
    kept = ranked.withColumn("_top", top).filter("_v = _top")
    return kept.groupBy("rule_id").agg(
        F.first("result").alias("result"), F.max_by("severity", "_s").alias("severity"), F.min_by("finding", "unit_position").alias("finding"),
        F.count_distinct("evidence_id").alias("evidences"), F.bool_and("complete").alias("complete"), F.min("unit_position").alias("unit_position"))
