"""Writers: whole tables, versions of them, and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a table: writes it beside the old one, then swaps the folders. A job that fails leaves the
    old table; between the two renames of the swap a reader may find none."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fresh, old, here = name(f"{path}.new-{mark}"), name(f"{path}.old-{mark}"), name(path)
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(fresh.toString())
        if files.exists(here) and not files.rename(here, old):
            raise OSError(f"{path} could not be moved aside")
        if not files.rename(fresh, here):
            files.rename(old, here)
            raise OSError(f"{path} could not be replaced")
    finally:
        for left in (fresh, old):
            if files.exists(here) and files.exists(left):
                files.delete(left, True)


def replace_versions(df: DataFrame, path: str, version: str) -> None:
    """Replaces only the versions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def report_lines(chunks: DataFrame, paper: str, order: str, text: str, most: int = 6) -> DataFrame:
    """One markdown text a paper: its first ``most`` chunks as numbered evidence."""
    w = Window.partitionBy(paper).orderBy(order)
    picked = chunks.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    parts = F.array_sort(F.collect_list(F.struct("_n", F.concat(F.lit("- [E"), "_n", F.lit("] "), text).alias("line"))))
    return picked.groupBy(paper).agg(F.concat(F.lit("# "), F.first(paper).cast("string"), F.lit("\n"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n")).alias("markdown"))
