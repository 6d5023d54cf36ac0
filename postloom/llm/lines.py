"""Line dedup with levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import HOT_SHARE, attach, fresh_path, release_memory, stage

MIN_DOCS = 10
MIN_CHARS = 1
KEY_BYTES = 16

#: Batches that a table is added in, and runs of a level that are merged into one of the next.
BATCHES = 6
FAN_IN = 3


def line_key(line: bytes) -> bytes:
    """The line as it is compared; ``bytes`` strips `[\\x20\\x09-\\x0D]` and lower-cases A-Z."""
    return line.strip().lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=KEY_BYTES).digest()


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    """Digests of a text's distinct line keys of at least ``min_chars`` code points."""
    keys = set(map(line_key, (text or b"").split(b"\n")))
    if min_chars > 1:
        keys = {k for k in keys if len(k.decode("utf-8", "replace")) >= min_chars}
    keys.discard(b"")
    return set(map(_digest, keys))


class LineRuns:
    """How many documents hold each line key, in levels of sorted runs.

    A run is a bucketed Parquet table of (key, n), sorted by key in each bucket
    and never changed. ``add`` anti-joins the counts of a new batch with the keys
    that the runs know as frequent and writes the batch as a run of level 0;
    when a level has ``fan_in`` runs they are merged into one of the next. As all
    runs share their buckets, joins and merges move the batch alone.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, counts: DataFrame, level: int) -> None:
        """``key, n, frequent`` as a run."""
        name = f"line_run_{uuid.uuid4().hex}"
        (
            counts.select("key", "n", (F.col("frequent") | (F.col("n") >= self.min_docs)).alias("frequent"))
            .write.partitionBy("frequent")
            .bucketBy(self.buckets, "key")
            .sortBy("key")
            .option("path", fresh_path(self.spark, "lines"))
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        runs = reduce(DataFrame.unionByName, map(self.spark.table, names))
        return runs.groupBy("key").agg(F.sum("n").alias("n"), F.bool_or("frequent").alias("frequent"))

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, counts: DataFrame) -> None:
        """``key, n``: a batch, with one row per key."""
        new = counts.withColumn("frequent", F.lit(False))
        if names := self._names():
            known = reduce(
                DataFrame.unionByName, [self.spark.table(x).where("frequent").select("key") for x in names]
            ).distinct()
            old = counts.join(known, "key", "left_semi").withColumn("frequent", F.lit(True))
            new = new.join(known, "key", "left_anti").unionByName(old)
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            merged, self.levels[level] = self.levels[level], []
            self._write(self._merged(merged), level + 1)
            self._drop(merged)
            level += 1

    def frequent(self) -> DataFrame:
        """``key, n`` of the keys that at least ``min_docs`` documents hold."""
        names = self._names()
        if not names:
            return self.spark.createDataFrame([], "key binary, n long")
        return self._merged(names).where(F.col("n") >= self.min_docs).select("key", "n")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._drop(self._names())
        self.levels = []


def _pairs(min_chars: int, batches: int):
    """(batch, digest of the text, key) for each text and distinct line; a batch is every so manieth task."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() % batches
        for table in tables:
            digests, keys = [], []
            for digest, text in zip(table["digest"].to_pylist(), table["text"]):
                found = _keys(text.as_py(), min_chars)
                digests += [digest] * len(found)
                keys += found
            yield pa.record_batch(
                {
                    "digest": pa.array(digests, pa.binary()),
                    "key": pa.array(keys, pa.binary()),
                    "batch": pa.array([batch] * len(keys), pa.int32()),
                }
            )
        release_memory()

    return run


def _without():
    """The texts without the lines whose keys are listed, and how many lines there were."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            n_lines, n_dropped, kept = [], [], []
            for text, dropped in zip(table["text"], table["dropped"]):
                data, drop = text.as_py() or b"", set(dropped.as_py() or ())
                lines = data.split(b"\n")
                left = lines
                if drop:
                    left = [x for x in lines if not (k := line_key(x)) or _digest(k) not in drop]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left) if drop else data)
            yield pa.record_batch(
                {
                    "doc_id": table["doc_id"],
                    "n_lines": pa.array(n_lines, pa.int64()),
                    "n_dropped": pa.array(n_dropped, pa.int64()),
                    "kept": pa.array(kept, pa.binary()),
                }
            )
        release_memory()

    return run


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text: Column = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def frequent_lines(pairs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> tuple[DataFrame, LineRuns]:
    """Add the batches of ``batch, key`` one after another; the frequent keys and the runs that hold them."""
    runs = LineRuns(pairs.sparkSession, min_docs)
    for batch in range(batches):
        runs.add(pairs.where(F.col("batch") == batch).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    return runs.frequent(), runs


def without_frequent_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Take the lines that many documents share out of every document.

    Texts are split at ``\\n``. A line's key is the line without
    `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased, as a 128-bit
    digest. Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines everywhere, in the first batches too. The
    documents' keys are counted batch by batch in ``LineRuns``. Then only (text
    digest, key) pairs meet the frequent keys, by broadcast for lines in over a
    thousandth of all pairs, else by shuffle; the keys of a text's dropped lines
    are listed once per distinct text and join the documents on its digest, the
    lists of texts with very many copies again by broadcast.

    Result: ``doc_id, n_lines, n_dropped, kept``, one row per input row; other
    columns are ignored. A null text is an empty one: one empty line, which
    stays. Repeated rows are documents of their own. A text of any length is
    handled whole, its lines one at a time; a document that loses all lines is
    empty. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "line-pairs")
    schema = "digest binary, key binary, batch int"
    rows = _digested(docs, id_col, text_col)
    found = rows.select("digest", "text").mapInArrow(_pairs(min_chars, batches), schema)
    found.write.partitionBy("batch").parquet(path)
    pairs = spark.read.schema(schema).parquet(path)
    total = pairs.count()
    frequent, runs = frequent_lines(pairs, min_docs, batches)
    frequent = stage(frequent, "frequent-lines")
    runs.close()
    hits = attach(pairs.select("digest", "key"), frequent, ["key"], "n", total)
    dropped = stage(
        hits.groupBy("digest", "key")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("digest")
        .agg(F.collect_list("key").alias("dropped"), F.max("copies").alias("copies")),
        "dropped-lines",
    )
    limit = max(2.0, total * HOT_SHARE)
    hot = F.broadcast(dropped.where(F.col("copies") > limit).drop("copies"))
    rest = dropped.where(F.col("copies") <= limit).drop("copies")
    few = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    with_lists = rows.join(hot, "digest").unionByName(few.join(rest, "digest", "left"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return (
        with_lists.select("doc_id", "text", "dropped")
        .mapInArrow(_without(), f"doc_id {id_type}, n_lines long, n_dropped long, kept binary")
        .withColumn("kept", F.col("kept").cast("string"))
    )
