"""Post tables in Parquet, one file or one partition directory per day."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.schemas import POSTS
from postloom.sources.catalogue import catalogue
from postloom.sources.dates import FILE, with_ingest_date

log = logging.getLogger(__name__)


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_posts(
    spark: SparkSession,
    paths: str | Sequence[str],
    dates: Sequence[str] | None = None,
    schema: T.StructType = POSTS,
    require_date: bool = False,
    default_date: str | None = None,
    store: str | None = None,
) -> DataFrame:
    """Scan post files; adds ``ingest_date`` from the path, whatever the layout.

    Files whose footer cannot be read are skipped whole, with a warning that
    names them and gives the numbers of valid and all files. Damage further
    inside a file fails the query, so a file is never read in part. ``dates`` keeps other
    days' files from being opened, their footers too. With ``store``, a folder
    that keeps the catalogue of files, a footer is opened only once.
    """
    days = None if dates is None else [*dates, *([None] if default_date in dates else [])]
    entries = catalogue(spark, paths, store, days)
    totals = entries.agg(F.count(F.lit(1)), F.count_if(~F.col("valid"))).first()
    # the damaged files, by name: a join would come after they are opened
    skipped = [r.path for r in entries.where(~F.col("valid")).select("path").collect()] if totals[1] else []
    if skipped:
        log.warning("Skipped %d of %d post files (%d valid): %s", len(skipped), totals[0], totals[0] - len(skipped), skipped)
    df = spark.read.schema(schema).parquet(*_paths(paths)).select(*schema.fieldNames(), F.col("_metadata"))
    if skipped:
        df = df.where(~F.col(FILE).isin(skipped))
    df = with_ingest_date(df, require_date, default_date)
    if dates is not None:
        df = df.where(F.col("ingest_date").isin(list(dates)))
    return df.drop("_metadata")


def file_report(
    spark: SparkSession, paths: str | Sequence[str], dates: Sequence[str] | None = None, store: str | None = None
) -> DataFrame:
    """``path, n_rows, valid`` of every matching file of ``dates``; see ``catalogue``."""
    return catalogue(spark, paths, store, dates).select("path", "n_rows", "valid")
