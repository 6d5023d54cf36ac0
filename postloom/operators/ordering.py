"""Time order of an output table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_by_time(df: DataFrame, time_col: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Ascending by a time string, NULLs last.

    Tie-breakers make the order total and let the range partitioning split a
    time stamp that very many rows share.
    """
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in (time_col, *tie_breakers)])
