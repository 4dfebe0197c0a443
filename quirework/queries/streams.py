"""Event-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query, table
from ..streaming import events as E
from ..streaming import json_field as J


@query("E01_bounded_log", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20")
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bounded_log(table(spark, sf_dir, "events"), "user_id", "event_id", 20).select("user_id", "event_id")


@query("E01_log_with_ttl", """WITH g AS (SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) > 86400000000 AS gap FROM events), k AS (SELECT *, coalesce(bool_or(coalesce(gap, false)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS gone FROM g)
 SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM k WHERE NOT gone) WHERE n <= 2000""")
def e01_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bounded_log(table(spark, sf_dir, "events"), "user_id", "event_id", 2000, "ts", 86400).select("user_id", "event_id")


@query("E02_resume", "SELECT event_id, event_type FROM events WHERE event_id > 700")
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.resume(table(spark, sf_dir, "events"), "event_id", 500, 700).select("event_id", "event_type")


@query("E03_client_reducer", """WITH a AS (SELECT user_id, event_id, value, event_id * 2 AS arrival FROM events UNION ALL SELECT user_id, event_id, value, event_id * 2 + 41 FROM events WHERE event_id % 7 = 0), s AS (SELECT *, coalesce(max(event_id) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS seen FROM a)
 SELECT user_id, count(*) AS accepted, max(event_id) AS last, round(sum(value), 6) AS total FROM s WHERE event_id > seen GROUP BY user_id""")
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_id") * 2).alias("arrival"))
    late = e.filter("event_id % 7 = 0").withColumn("arrival", F.col("arrival") + 41)
    return E.reduce_batch(e.union(late), "user_id", "event_id", "value")


@query("E04_nothing_after_terminal", "WITH s AS (SELECT user_id, event_id, event_type, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS ended FROM events) SELECT user_id, event_id FROM s WHERE ended IS NULL OR event_id <= ended")
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").withColumn("ended", ended).filter("ended is null or event_id <= ended").select("user_id", "event_id")


@query("E05_latest_event", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("E07_delta_chunks", "SELECT conv_id, turn, CAST(o AS INTEGER) AS \"offset\", substring(text, CAST(o AS INTEGER) + 1, 240) AS delta FROM (SELECT conv_id, turn, text, unnest(range(0, greatest(length(text), 1), 240)) AS o FROM conversations)")
def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.chunked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text").select("conv_id", "turn", "offset", "delta")


@query("E08_cancelled_tasks", "SELECT user_id, count(*) AS events FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0) GROUP BY user_id")
def e08(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.join(e.filter("event_id % 97 = 0").select("user_id").distinct(), "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("events"))


@query("E06_json_field", "SELECT conv_id * 1000 + turn AS message, role || ': ' || text AS value FROM conversations")
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message put into JSON, every e as a \\u escape, cut into pieces of seven characters, and read again as they
    come; SQL holds the message itself."""
    c = table(spark, sf_dir, "conversations")
    said = F.concat("role", F.lit(": "), "text")
    inner = F.to_json(F.struct(F.col("turn"), F.lit("not this").alias("tx"), said.alias("txt"), F.lit("nor that").alias("txu")))
    given = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message"), F.replace(inner, F.lit("e"), F.lit("\\u0065")).alias("json"))
    cut = E.chunked(given, "json", 7).withColumnRenamed("offset", "at")
    return J.whole_field(J.field_pieces(cut, "message", "at", "delta", "txt"), "message", "at")
