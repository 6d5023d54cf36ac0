"""Seeded samples of rows and of users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a row stands; the path breaks ties of files of one name.
PLACE = ("file_name", "row_index", "file_path")


def _draw(seed: int, cols: Sequence[str]) -> Column:
    """Pseudo-random order that depends on the values only, not on partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_users(df: DataFrame, n: int, seed: int = 42, col: str = "author") -> DataFrame:
    """``n`` distinct non-NULL values of ``col``, or all when there are fewer.

    Every task keeps its own ``n`` smallest draws, so only those reach the
    last step.
    """
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(
        _draw(seed, [col]), col
    ).limit(n)


def sample_rows(
    df: DataFrame, n: int, seed: int = 42, keys: Sequence[str] | None = None
) -> DataFrame:
    """``n`` random rows; a rerun gives the same ones, with other partitions too.

    The draw goes by unique ``keys``, or without any by the place of a row: its
    file's name and its number in it. Only rows of a frame that is not read from
    Parquet directly have no place; without keys their draw depends on partitions.
    """
    if keys:
        return df.orderBy(_draw(seed, keys), *keys).limit(n)
    columns = [F.col(c) for c in df.columns]
    try:
        placed = df.select(*columns, *(F.col(f"_metadata.{c}").alias(f"_{c}") for c in PLACE))
    except AnalysisException:
        return df.orderBy(F.rand(seed)).limit(n)
    place = [f"_{c}" for c in PLACE]
    return placed.orderBy(_draw(seed, place[:2]), *place).limit(n).drop(*place)
