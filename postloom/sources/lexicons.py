"""Lexicons kept as two tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Fields of the non-empty lines, numbered in file order with gaps."""
    lines = spark.read.text(path).withColumn("entry", F.monotonically_increasing_id())
    return lines.where(F.trim("value", F.lit(" \t\r")) != "").select(
        "entry", F.split(F.trim("value", F.lit(" \t\r")), "\t").alias("fields")
    )


def read_lexicon(spark: SparkSession, map_path: str, dict_path: str) -> DataFrame:
    """Rows (cat_idx, cat_name, keyword, is_stem, entry).

    The map file holds ``index <tab> name``, the dictionary file
    ``keyword <tab> index <tab> index ...`` with any number of categories.
    ``entry`` follows the order of the lines. A category without keyword keeps one
    row with NULLs; indices that the map does not name are left out.
    """
    categories = _lines(spark, map_path).select(
        F.trim(F.col("fields")[0]).cast("int").alias("cat_idx"),
        F.trim(F.col("fields")[1]).alias("cat_name"),
    )
    words = _lines(spark, dict_path).select(
        "entry",
        F.col("fields")[0].alias("keyword"),
        F.explode(F.slice("fields", F.lit(2), F.greatest(F.size("fields") - 1, F.lit(0)))).alias("idx"),
    )
    words = words.where(F.trim("idx") != "").withColumn("cat_idx", F.trim("idx").cast("int"))
    return categories.join(words, "cat_idx", "left").select(
        "cat_idx",
        "cat_name",
        "keyword",
        F.col("keyword").contains("*").alias("is_stem"),
        "entry",
    )
