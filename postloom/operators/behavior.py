"""Action counts per user."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.schemas import ACTION_COLUMNS
from postloom.sources.checks import require_columns


def user_action_counts(
    actions: DataFrame, action_map: Mapping[str, str] = ACTION_COLUMNS
) -> DataFrame:
    """One row per author with a count column for every action category.

    Authors without any known action do not appear, nor do NULL authors.
    Conditional counts need one shuffle with a map-side step, where a pivot
    would need two aggregations.
    """
    require_columns(actions, ["author", "type"])
    kind = F.col("type")
    categories: dict[str, list[str]] = {}
    for action, category in action_map.items():
        categories.setdefault(category, []).append(action)
    return (
        actions.where(kind.isin(*action_map) & F.col("author").isNotNull())
        .groupBy("author")
        .agg(*[F.count_if(kind.isin(*kinds)).alias(c) for c, kinds in categories.items()])
    )
