"""Derived relations that queries and their SQL define alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table

BLOCKS = """blocks AS (
  SELECT doc_id, lang, source, block_no, 1 + block_no // 10 AS page, content FROM (
    SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS content,
           CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS block_no FROM documents)
  WHERE trim(content) <> '')"""

LINES = """lines AS (
  SELECT l_orderkey * 10 + l_linenumber AS line_id, CAST(l_orderkey % 50 + 1 AS INTEGER) AS page, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y0,
         CAST(l_partkey % 500 AS DOUBLE) + 10 + l_quantity AS x1, CAST(l_suppkey * 7 % 700 AS DOUBLE) + 5 + l_linenumber AS y1,
         8 + round_even(l_tax * 50, 0) / 2 AS font_size, l_returnflag AS font, CAST(l_quantity AS INTEGER) AS chars FROM lineitem)"""

OBJECTS = """objects AS (
  SELECT p_partkey AS object_id, CAST(p_partkey % 50 + 1 AS INTEGER) AS page, CAST(p_size * 8 AS DOUBLE) AS x0, CAST(p_partkey * 13 % 650 AS DOUBLE) AS y0,
         CAST(p_size * 8 + 60 AS DOUBLE) AS x1, CAST(p_partkey * 13 % 650 + 40 AS DOUBLE) AS y1, CASE WHEN p_partkey % 2 = 0 THEN 'table' ELSE 'figure' END AS kind FROM part)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of documents, numbered, ten to a page."""
    d = table(spark, sf_dir, "documents")
    parts = d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("block_no", "content"))
    return parts.filter(F.trim("content") != "").select("doc_id", "lang", "source", "block_no", (F.lit(1) + F.floor(F.col("block_no") / 10)).alias("page"), "content")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines with boxes and fonts, made from lineitem."""
    x0, y0 = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") * 7 % 700).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), (F.col("l_orderkey") % 50 + 1).cast("int").alias("page"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 10 + F.col("l_quantity")).alias("x1"), (y0 + 5 + F.col("l_linenumber")).alias("y1"), (8 + F.bround(F.col("l_tax") * 50) / 2).alias("font_size"),
        F.col("l_returnflag").alias("font"), F.col("l_quantity").cast("int").alias("chars"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and tables with boxes, made from part."""
    p = table(spark, sf_dir, "part")
    x0, y0 = (F.col("p_size") * 8).cast("double"), (F.col("p_partkey") * 13 % 650).cast("double")
    return p.select(
        F.col("p_partkey").alias("object_id"), (F.col("p_partkey") % 50 + 1).cast("int").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 60).alias("x1"), (y0 + 40).alias("y1"),
        F.when(F.col("p_partkey") % 2 == 0, "table").otherwise("figure").alias("kind"))


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
