"""A stored catalogue of post files, so that a footer is opened once and only for the days asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.sources.dates import FILE, date_of_path

#: One entry per state of a file; ``ingest_date`` is NULL for files without a date in their path.
ENTRIES = "path string, length long, modified timestamp, ingest_date string, n_rows long, valid boolean"

#: A file without readable rows that is longer than this is no empty table.
EMPTY_BYTES = 16 << 20

STATE = ["path", "length", "modified"]
MARK = b"PAR1"


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _files(spark: SparkSession, paths: str | Sequence[str], *columns: Column) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(_paths(paths))
        .select(F.col(FILE).alias("path"), "length", F.col("modificationTime").alias("modified"), *columns)
    )


def _of_days(path: Column, days: Sequence[str | None] | None) -> Column:
    """Is a path of these days? Spark holds this against the listing, before it opens a file."""
    if days is None:
        return F.lit(True)
    known = [d for d in days if d is not None]
    return date_of_path(path).isin(known) | (date_of_path(path).isNull() if None in days else F.lit(False))


def list_files(
    spark: SparkSession, paths: str | Sequence[str], days: Sequence[str | None] | None = None
) -> DataFrame:
    """``path, length, modified, ingest_date`` of the files there are now; none is opened."""
    files = _files(spark, paths)
    return files.where(_of_days(F.col("path"), days)).withColumn("ingest_date", date_of_path("path"))


def readable_rows(
    spark: SparkSession, paths: str | Sequence[str], days: Sequence[str | None] | None = None, since: object = None
) -> DataFrame:
    """``path, n_rows`` of the files that have rows, from their footers.

    Only files of ``days`` that were changed at ``since`` or later are opened.
    """
    rows = spark.read.option("ignoreCorruptFiles", "true").schema("author string").parquet(*_paths(paths))
    rows = rows.where(_of_days(F.col(FILE), days))
    if since is not None:
        rows = rows.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    return rows.groupBy(F.col(FILE).alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))


def _empty_tables(spark: SparkSession, paths: str | Sequence[str], silent: DataFrame) -> DataFrame:
    """``path`` of those files without rows that begin and end as a Parquet file does.

    Only files as short as a silent one, and of its days, are read.
    """
    short = silent.where(F.col("length").between(12, EMPTY_BYTES))
    bounds = short.agg(F.min("length"), F.max("length"), F.collect_set("ingest_date"), F.count_if(F.col("ingest_date").isNull())).first()
    if bounds[0] is None:
        return silent.limit(0).select("path")
    days = [*bounds[2], *([None] if bounds[3] else [])]
    ends = (F.substring("content", 1, 4) == F.lit(MARK)) & (F.expr("substring(content, -4, 4)") == F.lit(MARK))
    marked = _files(spark, paths, ends.alias("marked")).where(F.col("length").between(bounds[0], bounds[1]))
    return marked.where(_of_days(F.col("path"), days) & F.col("marked")).select("path").join(short.select("path"), "path", "left_semi")


def _examined(
    spark: SparkSession, paths: str | Sequence[str], new: DataFrame, days: Sequence[str | None], since: object
) -> DataFrame:
    """The entries of files that the catalogue doesn't have yet."""
    found = new.join(readable_rows(spark, paths, days, since), "path", "left")
    empty = _empty_tables(spark, paths, found.where("n_rows IS NULL")).withColumn("empty", F.lit(True))
    return found.join(empty, "path", "left").select(
        *STATE,
        "ingest_date",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        (F.col("n_rows").isNotNull() | F.coalesce("empty", F.lit(False))).alias("valid"),
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(ENTRIES).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRIES)


def catalogue(
    spark: SparkSession, paths: str | Sequence[str], store: str | None = None, days: Sequence[str] | None = None
) -> DataFrame:
    """``path, length, modified, ingest_date, n_rows, valid`` of the files there are now.

    ``store`` is the folder that keeps the entries as Parquet. The listing
    meets it in an anti-join on path, length and time; only files without an entry are
    opened, and theirs are added. A file that was replaced gets a new entry, one
    that is gone none. ``days`` prunes the listing before all of this. Without a
    store the footers of those days are read every time.

    A file is valid if its footer can be read; a table without rows is. Damage
    further inside shows when the rows are read.
    """
    listed = list_files(spark, paths, days)
    known = spark.createDataFrame([], ENTRIES) if store is None else _stored(spark, store)
    new = listed.join(known, STATE, "left_anti")
    seen = new.agg(
        F.min("modified"), F.collect_set("ingest_date"), F.count_if(F.col("ingest_date").isNull())
    ).first()
    if seen[0] is None:
        found = known
    else:
        found = _examined(spark, paths, new, [*seen[1], *([None] if seen[2] else [])], seen[0])
        if store is not None:
            found.coalesce(1).write.mode("append").parquet(store)
            found = _stored(spark, store)
    return found.dropDuplicates(STATE).join(listed.select(*STATE), STATE, "left_semi")
