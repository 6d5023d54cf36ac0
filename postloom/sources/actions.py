"""Action logs in CSV with a header line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.sources.checks import require_columns


def read_actions_csv(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True
) -> DataFrame:
    """Read ``author, type, ...`` as text; empty fields are NULL.

    All files must have the same header, which is checked per file. The words
    ``NA`` and ``null`` are ordinary text. Quoted fields may hold line breaks,
    for which every file is one task: keep files of a moderate size.
    ``multi_line=False`` splits files and fails the query at a line whose quotes
    are not closed or whose number of fields is not the header's.
    """
    if not multi_line:
        return _single_lines(spark, paths)
    df = (
        spark.read.option("header", "true")
        .option("enforceSchema", "false")
        .option("escape", '"')
        .option("multiLine", "true")
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    require_columns(df, ["author", "type"])
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("author", "type")})


def _single_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One record per line; a broken quote gives a record of another width, which fails."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    checked = lines.select(
        F.when(odd, F.raise_error(F.concat(F.lit("A quote stays open in: "), F.col("value"))))
        .otherwise(F.col("value"))
        .alias("value")
    )
    names = (
        spark.read.option("header", "true").option("escape", '"').csv(paths if isinstance(paths, str) else list(paths)).columns
    )
    schema = ", ".join(f"`{n}` string" for n in names)
    record = F.from_csv("value", schema, {"escape": '"', "mode": "FAILFAST"})
    df = checked.select(F.explode(F.array(record)).alias("r")).select("r.*")
    require_columns(df, ["author", "type"])
    header = [F.col(f"`{n}`").eqNullSafe(F.lit(n)) for n in names]
    is_header = header[0]
    for h in header[1:]:
        is_header = is_header & h
    return df.where(~is_header).withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("author", "type")})
