"""Descriptive statistics of numeric columns, with exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.plans.scratch import scratch_path

QUANTILES = (0.25, 0.5, 0.75)

#: Size of a quantile sketch, and a share of ranks that its error rarely passes.
SKETCH_K = 1024
SKETCH_ERROR = 0.005

#: Values between the bounds of a quantile that are counted one by one; with more, the bounds are narrowed first.
EXACT_VALUES = 1 << 20


@dataclass(frozen=True)
class Range:
    """Bounds of some ranks of a feature: ``below`` values are less than ``low``, ``inside`` up to ``high``."""

    feature: str
    low: float
    high: float
    below: int
    inside: int

    def holds(self, ranks: tuple[int, int]) -> bool:
        return self.below <= ranks[0] and ranks[1] < self.below + self.inside


def _ordered(counts: DataFrame, partitions: int | None) -> DataFrame:
    """(feature, value, n) in ranges of (feature, value), numbered and written once.

    Ranges follow the distribution, so each holds about as many distinct values
    whatever their spread. Written out, the numbers stay as they are when rows are read again.
    """
    spark = counts.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "describe")
    ranges = counts.repartitionByRange(n, "feature", "value").withColumn("part", F.spark_partition_id())
    ranges.write.parquet(path)
    return spark.read.schema(ranges.schema).parquet(path)


def _values_at(ordered: DataFrame, totals: DataFrame, ranks: Column) -> DataFrame:
    """The value at every wanted 0-based rank of its sorted column.

    The counts of the ranges tell which range holds a rank. Only those ranges
    are read again, and each is ranked value by value in a task of its own.
    """
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per column and range
    parts = (
        ordered.groupBy("feature", "part")
        .agg(F.sum("n").alias("n"))
        .withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(F.broadcast(totals.select("feature", ranks.alias("ranks"))), "feature")
    )
    inside = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    wanted = parts.select("feature", "part", "below", inside.alias("ranks")).where(F.size("ranks") > 0)
    so_far = Window.partitionBy("feature", "part").orderBy("value")
    upto = F.col("below") + F.sum("n").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # at most two ranges per quantile and column
    rows = ordered.join(F.broadcast(wanted), ["feature", "part"]).withColumn("upto", upto)
    held = F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    return rows.select("feature", F.explode(held).alias("rank"), "value")


def _between(values: DataFrame, ranges: Sequence[Range]) -> DataFrame:
    """(key, value) for each range, by its number, and each value in it."""
    rows = [(r.feature, i, r.low, r.high) for i, r in enumerate(ranges)]
    bounds = values.sparkSession.createDataFrame(rows, "feature string, key int, low double, high double")
    met = values.join(F.broadcast(bounds), "feature").where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
    return met.select("key", "low", "high", "value")


def _narrowed(values: DataFrame, wanted: dict[Range, list[tuple[int, int]]]) -> dict[Range, list[tuple[int, int]]]:
    """Tighter ranges for the ranks of each, from a sketch of its values.

    A sketch has a fixed size and merges, so no value is shuffled. It may err:
    what lies below and inside the new bounds is counted, and ranks that are not
    inside keep their old range.
    """
    ranges = list(wanted)
    asked = []
    for i, r in enumerate(ranges):
        for ranks in wanted[r]:
            first, last = ((x - r.below) / max(1, r.inside - 1) for x in ranks)
            asked.append((i, *ranks, max(0.0, first - SKETCH_ERROR), min(1.0, last + SKETCH_ERROR)))
    spark = values.sparkSession
    sketches = _between(values, ranges).groupBy("key").agg(F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("sketch"))
    # a sketch is asked for given shares only
    at = lambda share: F.kll_sketch_get_quantile_double("sketch", F.lit(share))
    answers = F.array(
        *(
            F.when(
                F.col("key") == key,
                F.struct(F.lit(i).alias("i"), at(low).alias("low"), at(high).alias("high")),
            )
            for i, (key, _, _, low, high) in enumerate(asked)
        )
    )
    found = []
    for b in sketches.select(F.explode(F.filter(answers, lambda x: x.isNotNull())).alias("b")).select("b.*").collect():
        key, first, last, _, _ = asked[b.i]
        found.append((key, first, last, Range(ranges[key].feature, b.low, b.high, 0, 0)))
    # one row per rank: its old range, and the new bounds in it
    inner = spark.createDataFrame(
        [(key, i, new.low, new.high) for i, (key, _, _, new) in enumerate(found)], "key int, rank int, new_low double, new_high double"
    )
    counted = (
        _between(values, ranges)
        .join(F.broadcast(inner), "key")
        .groupBy("rank")
        .agg(
            F.count_if(F.col("value") < F.col("new_low")).alias("less"),
            F.count_if((F.col("value") >= F.col("new_low")) & (F.col("value") <= F.col("new_high"))).alias("inside"),
        )
    )
    out: dict[Range, list[tuple[int, int]]] = {}
    for row in counted.collect():
        key, first, last, new = found[row.rank]
        old = ranges[key]
        new = Range(new.feature, new.low, new.high, old.below + row.less, row.inside)
        out.setdefault(new if new.holds((first, last)) else old, []).append((first, last))
    return out


def _quantile_values(values: DataFrame, totals: Sequence, quantiles: Sequence[float], partitions: int | None) -> DataFrame:
    """(feature, rank, value) for the ranks that the quantiles lie between."""
    done: dict[Range, list[tuple[int, int]]] = {}
    for row in totals:
        positions = [(row["count"] - 1) * q for q in quantiles]
        whole = Range(row.feature, row["min"], row["max"], 0, row["count"])
        done[whole] = list(dict.fromkeys((floor(p), ceil(p)) for p in positions))
    while open_ranges := {r: x for r, x in done.items() if r.inside > EXACT_VALUES and r.low < r.high}:
        narrowed = _narrowed(values, open_ranges)
        closed = {r: x for r, x in done.items() if r not in open_ranges}
        # a narrowed range may be one that is closed already
        done = {r: closed.get(r, []) + narrowed.get(r, []) for r in [*closed, *(r for r in narrowed if r not in closed)]}
        if sum(r.inside for r in narrowed) * 2 > sum(r.inside for r in open_ranges):
            break  # few distinct values fill the ranges, or a sketch erred: the counts below take any size
    ranges = list(done)
    spark = values.sparkSession
    local = [(str(i), [x - r.below for x in sorted({y for pair in done[r] for y in pair})]) for i, r in enumerate(ranges)]
    ranks = spark.createDataFrame(local, "feature string, ranks array<long>")
    names = spark.createDataFrame([(str(i), r.feature, r.below) for i, r in enumerate(ranges)], "feature string, name string, below long")
    inside = _between(values, ranges).groupBy(F.col("key").cast("string").alias("feature"), "value").agg(F.count(F.lit(1)).alias("n"))
    found = _values_at(_ordered(inside, partitions), ranks, F.col("ranks"))
    return found.join(F.broadcast(names), "feature").select(
        F.col("name").alias("feature"), (F.col("rank") + F.col("below")).alias("rank"), "value"
    )


def _quantile_name(q: float) -> str:
    return f"p{q * 100:g}".replace(".", "_")


def describe_features(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    quantiles: Sequence[float] = QUANTILES,
    partitions: int | None = None,
) -> DataFrame:
    """count, mean, std, min, quantiles, max; one row per numeric column.

    NULL and NaN count as missing. Quantiles are exact with linear
    interpolation. The columns are written once; then mergeable sketches bound each
    quantile, again within the bounds while more than ``EXACT_VALUES`` values lie
    there, and only values inside are reduced to (column, value, count) and
    sorted. So no step shuffles all values, and a value that most rows share costs
    one row per task. ``partitions`` is the number of ranges that the distinct
    values are sorted into, the session's shuffle partitions unless given.
    """
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not cols:
        raise ValueError("No numeric column to describe")

    spark = df.sparkSession
    quoted = {c: F.col("`" + c.replace("`", "``") + "`").cast("double") for c in cols}
    path = scratch_path(spark, "described")
    df.select([col.alias(f"__{i}") for i, col in enumerate(quoted.values())]).write.parquet(path)
    values = (
        spark.read.schema(", ".join(f"__{i} double" for i in range(len(cols))))
        .parquet(path)
        .unpivot([], [f"__{i}" for i in range(len(cols))], "feature", "value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )
    # one row per column
    rows = values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ).collect()
    totals = spark.createDataFrame(rows, "feature string, count long, mean double, min double, max double")
    squares = F.sum(F.pow(F.col("value") - F.col("mean"), 2)).alias("squares")
    spread = values.join(F.broadcast(totals.select("feature", "mean")), "feature").groupBy("feature").agg(squares)
    at_rank = _quantile_values(values, rows, quantiles, partitions).groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")
    )

    def quantile(q: float) -> Column:
        position = (F.col("count") - 1) * F.lit(q)
        low = F.col("at")[F.floor(position)]
        high = F.col("at")[F.ceil(position)]
        return low + (high - low) * (position - F.floor(position))

    names = df.sparkSession.range(1).select(
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("position"), F.lit(f"__{i}").alias("feature"), F.lit(c).alias("name"))
                for i, c in enumerate(cols)
            ])
        ).alias("c")
    ).select("c.*")
    return (
        names.join(F.broadcast(totals), "feature", "left")
        .join(F.broadcast(spread), "feature", "left")
        .join(F.broadcast(at_rank), "feature", "left")
        .select(
            F.col("name").alias("feature"),
            F.coalesce("count", F.lit(0)).alias("count"),
            "mean",
            F.when(
                F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1))
            ).alias("std"),
            "min",
            *[quantile(q).alias(_quantile_name(q)) for q in quantiles],
            "max",
        )
    )
