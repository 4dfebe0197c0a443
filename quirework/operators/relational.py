"""Set, join, paging and replacement operators over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once, however often what follows uses them: a plain projection
    would be merged into the next one, use by use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def spread(df: DataFrame) -> DataFrame:
    """The same (narrow) rows, dealt to several tasks a core: a small file is few tasks, however much work follows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def bundled(df: DataFrame, keys: list[str], own: str, most: int) -> DataFrame:
    """``keys`` and ``own``: the ids of the rows equal in ``keys`` as arrays of at most ``most`` structs, in order.

    Pairs made bundle by bundle repeat the same few ids one stretch after the other, which columnar files store in
    a fraction of what the same pairs take in the order of a join."""
    at = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(own)) - 1) / most)
    return df.select(*keys, own, at.alias("_at")).groupBy(*keys, "_at").agg(F.array_sort(F.collect_list(F.struct(own))).alias(own)).drop("_at")


def authorised(owned: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """All or nothing: the requested rows if every requested id is owned, else none.

    Both counts are aggregates of narrow keys; only their comparison, one row, is broadcast."""
    wanted = requested.select(key).distinct()
    found = owned.join(wanted, key, "left_semi")
    whole = wanted.join(owned.select(key).distinct(), key, "left_anti").agg((F.count("*") == 0).alias("_whole"))
    return found.crossJoin(F.broadcast(whole)).filter("_whole").drop("_whole")


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows (1 to 100); ``order`` must be total."""
    size = min(100, max(1, size))
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """A gapless number from 1 in the given total order, without gathering all rows in one task.

    Rows are dealt by range; each part's offset is the number of rows before it, one small row a part."""
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*order)
    sizes = parts.groupBy("_part").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    return parts.withColumn("_own", F.row_number().over(own)).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both; of those with the same key the one of largest ``order``, new before old on a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def replace_subset(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``fresh``, and ``fresh``."""
    return old.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys (id, content hash, settings) haven't been done successfully."""
    return work.join(done.filter("status = 'ok'").select(*keys).distinct(), keys, "left_anti")


def replay(requests: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """outcome: proceed (key unknown), replay (same hash) or conflict (other hash)."""
    kept = stored.select(*keys, F.col("request_hash").alias("_hash"), "response")
    outcome = F.when(F.col("_hash").isNull(), "proceed").when(F.col("_hash") == F.col("request_hash"), "replay").otherwise("conflict")
    return requests.join(kept, keys, "left").withColumn("outcome", outcome).drop("_hash")
