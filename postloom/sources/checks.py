"""Input checks that fail on the driver, before any work starts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df
