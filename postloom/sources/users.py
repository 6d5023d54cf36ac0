"""User lists: one JSON document, lines of text, or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_users(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Users as a one-column frame ``author``, which may be long.

    ``form`` is ``json`` for one document (see ``read_user_list``), ``lines`` for
    text with one user per line, or ``table`` for Parquet with a column
    ``author``. The last two split over tasks and have no bound.
    """
    if form == "json":
        return read_user_list(spark, path)
    if form == "lines":
        users = spark.read.text(path).select(F.trim("value").alias("author")).where("author <> ''")
    elif form == "table":
        users = spark.read.schema("author string").parquet(path).where("author IS NOT NULL")
    else:
        raise ValueError(f"form: {form}")
    return users.distinct()


def read_user_list(spark: SparkSession, path: str) -> DataFrame:
    """Users of a JSON file as a one-column frame ``author``.

    The document is an object whose keys are user ids, or an array of ids; any
    other shape raises ``ValueError``, and a document that is cut off or broken fails the
    query. One JSON document cannot be split; a list
    that outgrows it belongs in a table, and every operator takes such a frame.
    """
    document = spark.read.text(path, wholetext=True)
    kinds = {
        r.kind
        for r in document.select(
            F.regexp_extract("value", r"^\s*(\S)", 1).alias("kind")
        ).collect()
    }
    if kinds == {"{"}:
        broken = F.raise_error(F.lit("The user list is no complete JSON object"))
        users = F.coalesce(F.json_object_keys("value"), broken.cast("array<string>"))
    elif kinds == {"["}:
        users = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
    else:
        raise ValueError("Expected a JSON object whose keys are user ids, or an array of ids")
    return document.select(F.explode(users).alias("author")).distinct()
