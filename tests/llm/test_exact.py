from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from postloom.llm.common import attach, bitmap, filter_bits, filter_positions, with_filter
from postloom.llm.exact import exact_duplicates


def brute(rows):
    groups = {}
    for key, text in rows:
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(hashlib.sha256(plain.encode()).hexdigest(), []).append(key)
    return groups


def test_like_brute_force(spark):
    rows = [(i, f"Text {i % 37} É" if i % 3 else f"TEXT {i % 5} é") for i in range(500)]
    rows += [(1000, None), (1001, ""), (1002, "Ä"), (1003, "ä"), (7, "twice"), (7, "TWICE"), (7, "Twice"), (None, "alone"), (None, "with"), (3, "with")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "'x' AS kept", "2 AS row")
    got = exact_duplicates(docs).collect()
    groups = brute(rows)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert {h: sorted(map(str, k)) for h, k in groups.items()} == {h: sorted(str(r.doc_id) for r in rs) for h, rs in by.items()}
    for h, rs in by.items():
        known = [k for k in groups[h] if k is not None]
        assert {r.keep_id for r in rs} == {max(known) if known else None}
        assert {r.group_size for r in rs} == {len(groups[h])}
        assert sum(r.kept for r in rs) == 1
        assert all(r.doc_id == r.keep_id for r in rs if r.kept)


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts(spark):
    long = "Ab " * 300_000
    got = exact_duplicates(spark.createDataFrame([(1, long), (2, long.upper()), (3, long + "x")], "doc_id long, text string"))
    assert {(r.doc_id, r.keep_id) for r in got.collect()} == {(1, 2), (2, 2), (3, 3)}


def test_bitmap_has_no_false_negatives(spark):
    bits = filter_bits(1000)
    items = spark.range(0, 1000)
    blocks = bitmap(items.select(F.explode(F.array(*filter_positions(F.col("id"), bits))).alias("position")))
    marked = with_filter(spark.range(0, 3000), F.col("id"), bits, blocks, "inside")
    got = {r.id: r.inside for r in marked.collect()}
    assert all(got[i] for i in range(1000))
    assert sum(got[i] for i in range(1000, 3000)) < 200


@pytest.mark.parametrize("total", [10, 100_000])
def test_attach_keeps_every_row(spark, total):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 1), (9, 9)], "k int, v int")
    groups = spark.createDataFrame([(1, 50), (2, 1), (3, 1)], "k int, n int")
    got = sorted(tuple(r) for r in attach(rows, groups, ["k"], "n", total).collect())
    assert got == sorted([(1, i, 50) for i in range(50)] + [(2, 0, 1), (3, 1, 1)])
