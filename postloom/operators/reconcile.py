"""Compare two result sets on their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side() -> Column:
    return (
        F.when(F.col("n_right") == 0, "left_only")
        .when(F.col("n_left") == 0, "right_only")
        .otherwise("both")
    )


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of either side: its row count on each side and a marker.

    Same answer as a full outer join with a side marker, but as one grouped
    count over the stacked keys: a single shuffle with a map-side step, NULL
    keys match each other, and repeated keys never multiply.
    """
    stacked = left.select(
        *keys, F.lit(1).alias("n_left"), F.lit(0).alias("n_right")
    ).unionAll(right.select(*keys, F.lit(0).alias("n_left"), F.lit(1).alias("n_right")))
    return (
        stacked.groupBy(*keys)
        .agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
        .withColumn("side", _side())
    )


def reconcile_summary(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per side: keys, rows of either frame, and rows of a full outer join.

    The last one adds up products of row counts and may pass the range of a long
    when a key is very frequent on both sides, so it is a decimal.
    """
    pairs = F.greatest("n_left", F.lit(1)).cast("decimal(19,0)") * F.greatest("n_right", F.lit(1)).cast("decimal(19,0)")
    return (
        reconcile(left, right, keys)
        .groupBy("side")
        .agg(
            F.count(F.lit(1)).alias("n_keys"),
            F.sum("n_left").alias("n_left"),
            F.sum("n_right").alias("n_right"),
            F.sum(pairs).cast("decimal(38,0)").alias("n_joined"),
        )
    )


def unmatched_rows(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole rows of either frame whose key is absent from the other one.

    Each frame is read for its rows and its keys; the keys of both are counted in one grouped
    pass, which leaves the ones of a single side, and one semi join with those keeps
    the rows. NULL keys match each other.
    """
    names = [f"__{k}" for k in keys]
    single = (
        reconcile(left, right, keys).where(F.col("side") != "both").select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    )
    stacked = left.withColumn("side", F.lit("left_only")).unionByName(
        right.withColumn("side", F.lit("right_only")), allowMissingColumns=True
    )
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return stacked.join(single, same, "left_semi")
