"""Parquet and CSV output."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["finish_runs", "remove", "write_by_date", "write_csv", "write_table"]

#: Folders in a table by date that readers skip: runs being written, and commit records.
RUNS, COMMITS = "_runs", "_commits"


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Parquet data set; a rerun replaces it."""
    df.write.mode(mode).parquet(path)


def write_by_date(
    df: DataFrame,
    path: str,
    order_by: Sequence[str] = (),
    date_col: str = "ingest_date",
    days: Sequence[str] | None = None,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """One directory per day; a rerun replaces only the days it holds.

    ``days`` names the days that were processed: those that got no row now lose
    what an earlier run left of them.

    The run is written beside the table, into a folder that readers don't see.
    Then one commit record names the days to put in place and those to take
    away, and the folders are moved. A run that fails before its record leaves the table
    as it was; one that fails later is finished by the next ``write_by_date`` or
    ``finish_runs``. One run writes a table at a time.

    Without an order the rows are rebalanced by day, which splits big days over
    several tasks and files. With one, days are cut into ranges of it: files of
    a day follow each other in order, and a big day still spreads.

    ``then`` is a narrow step, row by row, that the dealt and ordered rows take before they are
    written: what makes several rows of one is shuffled and sorted as that one. It leaves
    the day as it is.
    """
    spark, table = df.sparkSession, path.rstrip("/")
    if order_by:
        order = [F.col(c).asc_nulls_last() for c in (date_col, *order_by)]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        df = df.hint("rebalance", F.col(date_col))
    if then:
        df = then(df)
    run = f"run-{uuid.uuid4().hex}"
    df.write.partitionBy(date_col).parquet(f"{table}/{RUNS}/{run}")
    # the input may be this table, so what was left open is finished after it was read
    finish_runs(spark, table, run)
    written = [x for x in _names(spark, f"{table}/{RUNS}/{run}") if x.startswith(f"{date_col}=")]
    gone = [x for x in (f"{date_col}={day}" for day in days or ()) if x not in written]
    _commit(spark, table, run, written, gone)
    finish_runs(spark, table)


def finish_runs(spark: SparkSession, path: str, current: str = "") -> None:
    """Put the days of committed runs in place, and remove runs without a record but ``current``.

    Every step may be repeated, so a failure in here is made good by the next call.
    """
    table = path.rstrip("/")
    for name in _names(spark, f"{table}/{COMMITS}"):
        record = f"{table}/{COMMITS}/{name}"
        if name.endswith(".json"):
            run = f"{table}/{RUNS}/{name.removesuffix('.json')}"
            days = json.loads(_content(spark, record))
            for day in days["written"]:
                if day in _names(spark, run):
                    remove(spark, f"{table}/{day}")
                    _move(spark, f"{run}/{day}", f"{table}/{day}")
            for day in days["gone"]:
                remove(spark, f"{table}/{day}")
            remove(spark, run)
        remove(spark, record)
    for run in _names(spark, f"{table}/{RUNS}"):
        if run != current:
            remove(spark, f"{table}/{RUNS}/{run}")
    spark.catalog.refreshByPath(table)


def _commit(spark: SparkSession, table: str, run: str, written: list[str], gone: list[str]) -> None:
    """The record appears whole under its name, by a rename."""
    fs, draft = _folder(spark, f"{table}/{COMMITS}/{run}.draft")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"written": written, "gone": gone}).encode()))
    out.close()
    _move(spark, f"{table}/{COMMITS}/{run}.draft", f"{table}/{COMMITS}/{run}.json")


def _content(spark: SparkSession, path: str) -> str:
    fs, at = _folder(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, at = _folder(spark, source)
    if not fs.rename(at, _folder(spark, target)[1]):
        raise OSError(f"Cannot move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the file system that its path names, if it is there."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV export with header, for samples and reports."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
