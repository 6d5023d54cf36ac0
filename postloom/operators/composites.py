"""Composite scores: sums of lexicon category columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.schemas import COMPOSITES


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lexicon_composites(
    df: DataFrame, groups: Mapping[str, Sequence[str]] = COMPOSITES
) -> DataFrame:
    """Add one column per group; a NULL input makes its sums NULL."""
    missing = sorted({c for cols in groups.values() for c in cols} - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns for composites: {missing}")
    return df.withColumns(
        {name: reduce(add, [F.col(_quoted(c)) for c in cols]) for name, cols in groups.items()}
    )
