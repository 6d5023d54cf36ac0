"""The ingest date comes from the file path: its ``ingest_date=`` folder, else its first YYYY-MM-DD."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.schemas import DATE_PATTERN

FILE = "_metadata.file_path"


def date_of_path(path: Column | str) -> Column:
    """Date in a path, NULL when there is none."""
    col = F.col(path) if isinstance(path, str) else path
    return F.coalesce(
        F.nullif(F.regexp_extract(col, f"/ingest_date={DATE_PATTERN}/", 1), F.lit("")),
        F.nullif(F.regexp_extract(col, DATE_PATTERN, 1), F.lit("")),
    )


def with_ingest_date(
    df: DataFrame, required: bool = True, default: str | None = None
) -> DataFrame:
    """Add ``ingest_date`` to a frame that was just read from files.

    ``required=True`` fails the query at the first row of a file without a date;
    otherwise such rows get ``default``.
    """
    missing = (
        F.raise_error(F.concat(F.lit("No YYYY-MM-DD in the path of "), F.col(FILE)))
        if required
        else F.lit(default)
    )
    dated = df.withColumn("ingest_date", F.coalesce(date_of_path(F.col(FILE)), missing.cast("string")))
    # the check must hold for queries that don't select the date, too
    return dated.where(F.col("ingest_date").isNotNull()) if required else dated


def dates_of_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The days of all matching files, from their paths; nothing is opened."""
    listed = spark.read.format("binaryFile").load(list(paths)).select(date_of_path(F.col("path")).alias("day"))
    return sorted(r.day for r in listed.where("day IS NOT NULL").distinct().collect())
