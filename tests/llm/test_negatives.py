from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from postloom.llm import negatives
from postloom.llm.negatives import hard_negatives, shifted_labels

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, count=10):
    """All scores of every anchor, sorted; each positive's window is filtered from all rows."""
    known = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, [math.floor(256 * x) for x in vector])
        known[key] = min(known.get(key, row), row)
    out = []
    for anchor, (label, vector) in known.items():
        if anchor % 100:
            continue
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), k, y) for k, (y, v) in known.items() if k != anchor)
        for s, positive, _ in [x for x in scores if x[2] == label][:positives]:
            near = [(-n, k) for n, k, y in scores if y != label and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(anchor, positive, i + 1, k, -s, n) for i, (n, k) in enumerate(near[:count])]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA, **options):
    got = hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, labels, seed=1, width=6, step=0.25):
    chance = random.Random(seed)
    return [(i * 5, [step * chance.randint(-4, 6) for _ in range(width)], chance.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("labels", [1, 2, 7])
def test_like_brute_force(spark, labels):
    """Coarse components give many ties; one label has no negatives at all."""
    rows = vectors(400, labels)
    assert mined(spark, rows) == brute(rows)


def test_blocks(spark, monkeypatch):
    """Many blocks of rows and of anchors, and a label with most rows."""
    rows = [(k, v, 0 if k % 3 else y) for k, v, y in vectors(1500, 4, seed=2)] + vectors(60, 3, seed=3, step=0.5)
    want = brute(rows)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 256)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 64)
    assert mined(spark, rows) == want


def test_one_vector_many_times(spark):
    rows = [(i, [1.0, 0.5], 0 if i % 4 else 1) for i in range(600)] + [(1000 + i, [0.5, 0.25], 2) for i in range(50)]
    assert mined(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = vectors(200, 3)
    odd = [
        (0, [1.0, float("nan")], 1),
        (7, [float("inf")], 1),
        (8, None, 1),
        (9, [1.0, None], 1),
        (11, [1.0], None),
        (None, [1.0] * 6, 1),
        (12, [1.0, 1.0], 1),
        (13, [], 2),
        (rows[3][0], [2.0] * 6, 0),
        rows[4],
        rows[4],
    ]
    assert mined(spark, rows + odd) == brute(rows + odd)


def test_no_rows_and_clashing_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    rows = vectors(150, 3)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "'x' AS anchor", "2 AS q", "3 AS slot", "4 AS i", "5 AS score")
    assert sorted(map(tuple, hard_negatives(frame, F.col("vec_id") % 100 == 0).collect())) == brute(rows)


def test_scores_that_floating_point_cannot_hold(spark):
    rows = [(0, [1e6, 1.0], 1), (1, [1e6, 1.0], 1), (2, [8e5, 0.0], 2), (3, [8e5, 1 / 256], 2), (4, [8e5, -1 / 256], 3)]
    assert mined(spark, rows) == brute(rows)


def test_other_limits(spark):
    rows = vectors(300, 3)
    got = mined(spark, rows, positives=2, negatives=3)
    assert got == brute(rows, 2, 3)


def test_shifted_labels(spark):
    rows = [(0, 9), (7, 3), (8, 9), (None, 5), (14, None), (21, -1), (28, 2**31 - 1)]
    got = shifted_labels(spark.createDataFrame(rows, "vec_id long, label int")).collect()
    assert [r.label for r in got] == [0, 4, 9, 5, None, 0, 2**31 % 10]
