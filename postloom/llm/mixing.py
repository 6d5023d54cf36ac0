"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import attach, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
COPIES = 3

#: Rows of one source that a window task numbers at a time.
SLICE_ROWS = 5_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """``source, rank, source_size, target`` from ``source, size``.

    Sources in code point order, null last, take the weights in turn and share
    the sum of all sizes. A target stops at ``copies`` times its source's size;
    the excess is shared again by weight, until none is above. That is one
    water level: in the order of (cap / weight), the first level that doesn't pass
    the next cap. One row per source goes through these windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "rank")
    so_far = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("ratio", (F.col("source_size") * copies).cast("double") / F.col("weight"))
    )
    everyone = Window.partitionBy()
    levelled = sources.withColumns(
        {
            "total": F.sum("source_size").over(everyone),
            "capped": F.coalesce(F.sum(F.col("source_size") * copies).over(so_far), F.lit(0)),
            "open": F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(so_far), F.lit(0)),
        }
    ).withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open"))
    level = F.min_by(
        F.when(F.col("level") <= F.col("ratio"), F.col("level")),
        F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank")),
    ).over(everyone)
    return levelled.select(
        "source",
        "rank",
        "source_size",
        F.least((F.col("source_size") * copies).cast("double"), level * F.col("weight")).alias("target"),
    )


def _finish(copy: int) -> Column:
    """Virtual finish time of a document's copy: its source's words up to its end, over the target."""
    words = (F.col("source_size") * copy + F.col("cumulative")).cast("double")
    return F.when(F.col("target") > 0, words / F.col("target"))


def _place(copy: int) -> Column:
    return F.struct(_finish(copy).alias("finish"), "rank", "key", "doc_id", "size", F.lit(copy).alias("copy"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    copies: int = COPIES,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame, int]:
    """How often the mix takes each distinct (id, source, size), the sizes of all rows, and their number.

    Documents are shuffled by a hash of seed and id. A document's copy finishes
    at (its source's words up to its end, the copy's earlier rounds included) /
    target. All copies are range-sorted by finish time; the mix is the longest
    run of them whose words stay within the sum of all sizes. The running sums use
    slices of the shuffled order and ranges of the finish times, so no task holds a whole
    source and a source with any share of the rows is spread. Rows of equal id,
    source and size are one entry, with one finish time.
    """
    spark = docs.sparkSession
    sized = stage(
        docs.select(
            F.struct(
                F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(F.col(text_col)).alias("size")
            ).alias("at")
        ),
        "sizes",
    )
    n = sized.count()
    key = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("at.doc_id").cast("string"), F.lit(""))), 256)
    slices = 1
    while slices * SLICE_ROWS < n:
        slices *= 2
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    entries = (
        sized.groupBy("at")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("at", "at.*", "rows", key.alias("key"))
        .withColumn("words", F.col("size") * F.col("rows"))
        .withColumn("slice", F.shiftright(head * slices, 32))
    )
    targets = stage(source_targets(sized.select("at.source", "at.size"), weights, copies), "targets")
    in_source = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        entries.groupBy("source", "slice")
        .agg(F.sum("words").alias("in_slice"))
        .withColumn("before", F.coalesce(F.sum("in_slice").over(in_source), F.lit(0)))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("of"), F.col("slice").alias("in"), "before", "rank", "source_size", "target")
    )
    in_slice = (
        Window.partitionBy("source", "slice")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = stage(
        entries.withColumn("within", F.sum("words").over(in_slice))
        .join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("in")))
        .select(
            "at", "doc_id", "size", "words", "rows", "key", "rank", "source_size", "target",
            (F.col("before") + F.col("within")).alias("cumulative"),
        ),
        "placed",
    )

    # the global range sort; each range's words, then the range where the budget ends
    names = ["finish", "rank", "key", "doc_id", "size", "copy"]
    places = (
        placed.select("words", F.explode(F.array(*map(_place, range(copies)))).alias("place"))
        .select("words", "place.*")
        .where(F.col("finish").isNotNull())
    )
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), copies * n // 500_000 + 1)
    ordered = stage(
        places.repartitionByRange(ranges, *names).withColumn("part", F.spark_partition_id()), "ordered"
    )
    budget = sized.agg(F.coalesce(F.sum("at.size"), F.lit(0))).first()[0]
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ending = (
        ordered.groupBy("part")
        .agg(F.sum("words").alias("in_part"))
        .withColumn("before", F.coalesce(F.sum("in_part").over(before), F.lit(0)))
        .where(F.col("before") + F.col("in_part") > budget)
        .orderBy("part")
        .first()
    )
    in_mix = F.lit(True)
    if ending is not None:
        running = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
        row = (
            ordered.where(F.col("part") == ending["part"])
            .withColumn("taken", F.sum("words").over(running) + ending["before"])
            .where(F.col("taken") > budget)
            .agg(F.min(F.struct(*names)).alias("cut"))
            .first()["cut"]
        )
        in_mix = F.struct(*(F.lit(row[f]).cast(ordered.schema[f].dataType).alias(f) for f in names))
    n_copies = F.lit(0)
    for c in range(copies):
        inside = F.lit(True) if ending is None else _place(c) < in_mix
        n_copies = n_copies + (_finish(c).isNotNull() & inside).cast("int")
    counted = F.when(F.col("size") == 0, F.least(n_copies, F.lit(1))).otherwise(n_copies).cast("long")
    return placed.select("at", "rows", "source_size", "target", counted.alias("n_copies")), sized, n


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken, n_copies`` of each row; see ``mixture``.

    ``taken`` is ``size * n_copies``. A null text has size 0; a document
    without words is taken once if its first copy lies in the mix. Null ids and sources
    count like others (the null source is the last). Repeated rows count as many times as they stand and are
    taken alike; the same rows give the same result whatever their order. No words at all
    or an empty table: targets 0, nothing taken. Other columns are ignored.
    """
    entries, sized, n = mixture(docs, **settings)
    return attach(sized, entries, ["at"], "rows", n).select(
        "at.doc_id", "at.size", "source_size", "target",
        (F.col("at.size") * F.col("n_copies")).alias("taken"),
        "n_copies",
    )


def repeat_taken(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings
) -> DataFrame:
    """The rows, with all their columns, each as often as the mix takes it."""
    entries, _, n = mixture(docs, id_col=id_col, text_col=text_col, source_col=source_col, **settings)
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    at = F.struct(
        F.col(of[id_col]).alias("doc_id"), F.col(of[source_col]).alias("source"), _size(F.col(of[text_col])).alias("size")
    )
    taken = attach(docs.toDF(*names).withColumn("at", at), entries, ["at"], "rows", n)
    times = F.explode(F.array_repeat(F.lit(1), F.col("n_copies").cast("int")))
    return taken.select(*names, times.alias("time")).drop("time").toDF(*docs.columns)
