"""Readers with the checks that pipelines rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a malformed line fails the read; else it gives nulls. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document in a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_mapping(spark: SparkSession, path: str, schema: str, key: str, required: list[str]) -> DataFrame:
    """A keyed mapping; raises on rows without a required field and on keys that repeat."""
    rows = read_jsonl(spark, path, schema)
    lacking = F.lit(False)
    for name in required:
        lacking = lacking | F.col(name).isNull() | (F.col(name).cast("string") == "")
    if rows.filter(lacking).limit(1).count():
        raise ValueError(f"{path}: rows without one of {required}")
    if rows.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{path}: {key} repeats")
    return rows


def locate_artifact(spark: SparkSession, folder: str) -> str | None:
    """``layout.json`` in a folder, else the first ``*_content_list.json`` by name, else None."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.when(name == "layout.json", 0).when(name.endswith("_content_list.json"), 1)
    best = found.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "path").limit(1).collect()
    return best[0]["path"] if best else None


def response_chunks(payloads: DataFrame, body: str) -> DataFrame:
    """Chunks of answers that hold them at one of two places."""
    kind = "array<struct<id:string,content:string,similarity:double>>"
    at = lambda p: F.from_json(F.get_json_object(body, p), kind)
    return payloads.withColumn("chunk", F.explode_outer(F.coalesce(at("$.data.chunks"), at("$.data.reference.chunks"))))


def run_counts(paths: DataFrame, root: str) -> DataFrame:
    """run, file_count: the folders right below ``root`` and the files in each at any depth; files that
    lie in ``root`` itself belong to none. ``paths``: path, as ``binaryFile`` lists them."""
    below = F.split(F.substr("path", F.lit(len(root.rstrip("/")) + 2)), "/")
    inside = paths.filter(F.startswith("path", F.lit(root.rstrip("/") + "/"))).select(below.alias("parts")).filter(F.size("parts") > 1)
    return inside.groupBy(F.element_at("parts", 1).alias("run")).agg(F.count("*").alias("file_count"))
