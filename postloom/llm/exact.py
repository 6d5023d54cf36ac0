"""Exact dedup by two-pass Bloom filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import attach, bitmap, filter_bits, filter_positions, stage, with_filter

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: which row of its equal texts stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The first pass puts the SHA-256 of each text into a Bloom filter with
    counters that stop at two, kept as a bitmap of the positions met twice. The
    second pass lets every row go straight through of which a bit is not in that
    bitmap: its text occurs once. Only the remaining rows, without their texts,
    are shuffled and grouped by digest, so false positives change nothing. The
    bitmap has 16 bits a row up to ``MAX_FILTER_BITS``; over about 100 million
    rows it lets more unique rows through to the shuffle, and results stay whole.

    Result: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input
    row, other columns ignored. The largest id stays; null ids are the smallest.
    Of rows repeated with the same id and text exactly one is ``kept``. An
    empty table gives an empty result.
    """
    digest = F.sha2(F.encode(F.translate(F.coalesce(text_col, F.lit("")), UPPER, UPPER.lower()), "UTF-8"), 256)
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(digest).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    n = rows.count()
    bits = filter_bits(n)
    met_twice = (
        rows.select(F.explode(F.array(*filter_positions(F.col("digest"), bits))).alias("position"))
        .groupBy("position")
        .count()
        .where("count > 1")
    )
    marked = stage(with_filter(rows, F.col("digest"), bits, bitmap(met_twice), "repeated"), "marked")

    once = marked.where(~F.col("repeated")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "digest",
    )
    perhaps = marked.where("repeated")
    groups = stage(
        perhaps.groupBy("digest").agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")
        ),
        "groups",
    )
    grouped = attach(perhaps, groups, ["digest"], "group_size", n).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "digest",
    )
    return once.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
