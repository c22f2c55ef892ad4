"""Lines of text files with their numbers, read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(file, filename, line, value) of every line below ``path``; ``line`` counts from 1.

    A file of any size is read by splits. Lines of a split are counted where they are
    read, and a small table of one row per split tells how many lines stand before it.
    """
    lines = spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("filename"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        F.monotonically_increasing_id().alias("pos"),
    )
    blocks = lines.groupBy("file", "block").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    number = F.col("before") + F.col("pos") - F.col("first") + 1
    return lines.join(starts, ["file", "block"]).select("file", "filename", number.alias("line"), "value")
