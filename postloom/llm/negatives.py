"""Hard-negative mining by slot-decomposed selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import stage

#: Vectors of one block, and anchors that meet it at a time; a block has at most BLOCK_VALUES components.
BLOCK_ROWS = 8192
BLOCK_ANCHORS = 2048
BLOCK_VALUES = 1 << 23

#: Scores that a task holds at a time.
STRIPE_SCORES = 1 << 20


def usable(
    vectors: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: str, scale: int
) -> DataFrame:
    """``id, label, anchor, q``: the rows that take part, one per id, with whole-number vectors."""
    values = F.transform(vector_col, lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    row = F.struct(
        F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.transform(values, lambda x: F.floor(x * F.lit(float(scale)))).alias("q"),
    )
    known = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    return (
        vectors.where(known & finite)
        .select(F.col(id_col).cast("long").alias("id"), row.alias("row"))
        .groupBy("id")
        .agg(F.min("row").alias("row"))
        .select("id", "row.*")
    )


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    lists = vectors.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), within] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact; beyond 64 bits they wrap around as Spark's do."""
    most = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, best first; of equal ones the earlier."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)]))
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, ~scores[at]))]


class _Cell:
    """A block of vectors, in id order, and the anchors that meet it."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        self.anchors = anchors
        rows = rows.sort_by("id")
        self.ids = rows["id"].to_numpy()
        self.labels = rows["label"].to_numpy()
        self.anchor_ids = anchors["id"].to_numpy()
        self.anchor_labels = anchors["label"].to_numpy()
        width = max(
            (int(x["q"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for x in (anchors, rows)),
            default=0,
        )
        self.q = _matrix(rows["q"], width)
        self.anchor_q = _matrix(anchors["q"], width)

    def scores(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the anchor, its scores), some anchors multiplied at a time."""
        step = max(1, STRIPE_SCORES // max(1, len(self.ids)))
        for low in range(0, len(self.anchor_ids), step):
            for k, scores in enumerate(_products(self.anchor_q[low : low + step], self.q)):
                yield low + k, scores


def _found(anchor: list, columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table(
        {"anchor_id": pa.array(anchor, pa.int64())} | {c: pa.array(v, kinds[c]) for c, v in columns.items()}
    )


def _nearest(k: int):
    """Of each anchor the first ``k`` rows of its label in a cell."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        cell = _Cell(anchors, rows)
        anchor, ids, found = [], [], []
        of_label = {label: np.flatnonzero(cell.labels == label) for label in np.unique(cell.anchor_labels)}
        for label, at in of_label.items():
            mine = np.flatnonzero(cell.anchor_labels == label)
            step = max(1, STRIPE_SCORES // max(1, len(at)))
            for low in range(0, len(mine), step):
                part = mine[low : low + step]
                for a, scores in zip(part, _products(cell.anchor_q[part], cell.q[at])):
                    others = cell.ids[at] != cell.anchor_ids[a]
                    ids_of, scores_of = cell.ids[at][others], scores[others]
                    best = _first(scores_of, k)
                    anchor += [int(cell.anchor_ids[a])] * len(best)
                    ids += ids_of[best].tolist()
                    found += scores_of[best].tolist()
        return _found(anchor, {"id": ids, "score": found}, {"id": pa.int64(), "score": pa.int64()})

    return run


def _slots(k: int):
    """Of each anchor and slot the first ``k`` rows of other labels in a cell: the combiner."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        cell = _Cell(anchors, rows)
        uppers, least = anchors["uppers"].to_pylist(), anchors["least"].to_pylist()
        anchor, slots, ids, found = [], [], [], []
        for a, scores in cell.scores():
            inside = np.flatnonzero((cell.labels != cell.anchor_labels[a]) & (scores >= least[a]) & (scores <= uppers[a][0]))
            low = [*(u + 1 for u in uppers[a][1:]), least[a]]
            for slot, (first, last) in enumerate(zip(low, uppers[a])):
                at = inside[(scores[inside] >= first) & (scores[inside] <= last)]
                best = at[_first(scores[at], k)]
                anchor += [int(cell.anchor_ids[a])] * len(best)
                slots += [slot] * len(best)
                ids += cell.ids[best].tolist()
                found += scores[best].tolist()
        kinds = {"slot": pa.int32(), "id": pa.int64(), "score": pa.int64()}
        return _found(anchor, {"slot": slots, "id": ids, "score": found}, kinds)

    return run


def _meet(anchors: DataFrame, rows: DataFrame, n: tuple[int, int], run, schema: str) -> DataFrame:
    """Every block of anchors with every block of rows, each pair of blocks in a group of its own."""
    blocks, anchor_blocks = n
    of = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = anchors.withColumn("j", of(anchor_blocks)).withColumn("i", upto(blocks))
    own = [F.col(c).alias(c) for c in ("id", "label", "q")]  # both sides may stem from one table
    right = rows.select(*own).withColumn("i", of(blocks)).withColumn("j", upto(anchor_blocks))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, schema)


def _limit(score: Column, percent: int, up: bool) -> Column:
    share = score.cast("decimal(19,0)") * F.lit(percent).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")
    return (F.ceil if up else F.floor)(share).cast("long")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """For the anchors and their positives: rows of another label that score nearly as high.

    Components become ``floor(scale * x)``; a row's score is its inner product
    with the anchor, higher ones first, ties by smaller id. The positives of an
    anchor are its first ``positives`` other rows of the same label. A positive's
    window holds the scores from ``low`` to ``high`` percent of its own; its
    negatives are the first ``negatives`` rows of other labels in there.

    Windows of one anchor overlap, so nothing is searched per positive. The
    distinct upper limits of an anchor's windows, in descending order, cut its
    scores into disjoint slots; each block of rows keeps the first ``negatives``
    of every slot, and so does the merge over blocks. What lies under a window's
    upper limit is its slot and all later ones: the first rows of that suffix
    that reach the lower limit are the answer. Blocks are bounded, and every
    block of anchors meets every block of rows in its own group, so neither a hot
    label nor a repeated vector makes a group larger.

    Result: ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``. Rows with a null id, label, vector or a component that is
    null or not finite take no part; of rows that share an id the one with the
    smallest label and then vector does. Shorter vectors count as ending in
    zeros. A negative positive score has an empty window. Scores beyond 64 bits
    wrap around. Other columns are ignored; an empty table, or one without
    anchors, gives an empty result.
    """
    points = stage(usable(vectors, anchors, id_col, vector_col, label_col, scale), "points")
    size = points.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors"), F.max(F.size("q")).alias("width")
    ).first()
    rows_each = max(256, min(BLOCK_ROWS, BLOCK_VALUES // max(1, size.width or 1)))
    anchors_each = max(64, min(BLOCK_ANCHORS, BLOCK_VALUES // max(1, size.width or 1)))
    n = (max(1, -(-size.rows // rows_each)), max(1, -(-size.anchors // anchors_each)))
    queries = points.where("anchor").select("id", "label", "q")

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = _meet(queries, points, n, _nearest(positives), "anchor_id long, id long, score long")
    pairs = stage(
        near.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= positives)
        .where("score >= 0")
        .select(
            "anchor_id",
            F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
            _limit(F.col("score"), low, True).alias("lower"),
            _limit(F.col("score"), high, False).alias("upper"),
        ),
        "positives",
    )
    limits = pairs.groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("least")
    )
    inside = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    kept = (
        _meet(queries.join(limits, "id"), points, n, _slots(negatives), "anchor_id long, slot int, id long, score long")
        .withColumn("place", F.row_number().over(inside))
        .where(F.col("place") <= negatives)
    )
    found = kept.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("found")
    )
    slot = F.array_position("uppers", F.col("upper")) - 1
    suffix = F.slice(F.filter("found", lambda x: x.slot >= F.col("slot")), 1, negatives)
    return (
        pairs.join(limits.withColumnRenamed("id", "anchor_id"), "anchor_id")
        .join(found, "anchor_id")
        .withColumn("slot", slot)
        .withColumn("window", F.filter(suffix, lambda x: x.score >= F.col("lower")))
        .select("anchor_id", "positive_id", "positive_score", F.posexplode("window").alias("at", "negative"))
        .select(
            "anchor_id",
            "positive_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("negative.id").alias("negative_id"),
            "positive_score",
            F.col("negative.score").alias("negative_score"),
        )
    )


def shifted_labels(vectors: DataFrame, every: int = 7, labels: int = 10, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """Label noise: rows whose id is divisible by ``every`` get the next of ``labels`` labels."""
    following = ((F.col(label_col).cast("decimal(20,0)") + 1) % labels).cast("long")
    noisy = F.when(F.col(id_col) % every == 0, following).otherwise(F.col(label_col).cast("long"))
    return vectors.withColumn(label_col, noisy)
