import importlib
import math
import random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from postloom.operators import describe_features
from postloom.operators.describe import _ordered

describe = importlib.import_module("postloom.operators.describe")

NAMES = {"count": "count", "mean": "mean", "std": "std", "min": "min", "25%": "p25",
         "50%": "p50", "75%": "p75", "max": "max"}


def _check(spark, pdf, parts=3):
    df = spark.createDataFrame(pdf).repartition(parts)
    got = {r.feature: r for r in describe_features(df).collect()}
    want = pdf.describe()
    assert sorted(got) == sorted(want.columns)
    for col in want.columns:
        for theirs, ours in NAMES.items():
            value, expected = got[col][ours], want[col][theirs]
            if math.isnan(expected):
                assert value is None, (col, ours)
            else:
                assert value == pytest.approx(expected, rel=1e-9, abs=1e-12), (col, ours)


def test_equals_pandas(spark):
    rng = random.Random(3)
    n = 2000
    _check(
        spark,
        pd.DataFrame(
            {
                "zeros": [0] * n,
                "mostly zero": [rng.choice([0, 0, 0, 0, 1, 7]) for _ in range(n)],
                "uniform": [rng.random() for _ in range(n)],
                "heavy tail": [10 ** rng.uniform(-300, 300) for _ in range(n)],
                "negative": [rng.gauss(-5, 1e-9) for _ in range(n)],
                "one outlier": [1e300] + [rng.random() for _ in range(n - 1)],
            }
        ),
    )


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7])
def test_small_frames(spark, n):
    _check(spark, pd.DataFrame({"x": [float(i * i) for i in range(n)], "y": [4] * n}))


def test_missing_values(spark):
    df = spark.createDataFrame(
        [(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "a double, `b:c` double"
    )
    rows = {r.feature: r for r in describe_features(df).collect()}
    assert (rows["a"]["count"], rows["a"].mean, rows["a"].p50) == (2, 2.0, 2.0)
    assert rows["b:c"]["count"] == 0 and rows["b:c"].mean is None and rows["b:c"]["max"] is None


def test_infinite_values_do_not_break_quantiles(spark):
    df = spark.createDataFrame(
        [(v,) for v in (float("-inf"), 1.0, 2.0, 3.0, float("inf"))], "a double"
    )
    row = describe_features(df).first()
    assert (row["min"], row.p25, row.p50, row.p75, row["max"]) == (
        float("-inf"), 1.0, 2.0, 3.0, float("inf"),
    )


def test_empty_frame(spark):
    row = describe_features(spark.createDataFrame([], "a int, s string")).collect()
    assert len(row) == 1 and row[0]["count"] == 0 and row[0].p50 is None


def test_other_quantiles_and_columns(spark):
    df = spark.range(101).selectExpr("id", "id * 2 AS twice", "'x' AS s")
    row = describe_features(df, ["twice"], [0.0, 0.125, 1.0]).first()
    assert (row.feature, row.p0, row.p12_5, row.p100) == ("twice", 0.0, 25.0, 200.0)
    with pytest.raises(ValueError):
        describe_features(df.select("s"))


def test_input_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(5000).selectExpr("id % 7 AS a", "rand(1) AS b").mapInArrow(count, "a long, b double")
    assert len(describe_features(df).collect()) == 2
    assert read.value == 5000


def test_no_task_gets_most_of_a_skewed_column(spark):
    """Spread over very many powers of ten, or all but two values in one corner."""
    rng = random.Random(9)
    n = 20_000
    pdf = pd.DataFrame(
        {
            "log-normal": [rng.lognormvariate(0, 10) for _ in range(n)],
            "two outliers": [1e150, 1e300] + [rng.random() for _ in range(n - 2)],
        }
    )
    _check(spark, pdf)
    ordered = _ordered(
        spark.createDataFrame(pdf).unpivot([], list(pdf.columns), "feature", "value").withColumn("n", F.lit(1)), 16
    )
    sizes = [r["count"] for r in ordered.groupBy("part").count().collect()]
    assert sum(sizes) == 2 * n and max(sizes) < 2 * (2 * n / 16)


def test_sketches_bound_the_quantiles(spark, monkeypatch):
    """Bounds are narrowed several times, and what remains is exact."""
    monkeypatch.setattr(describe, "EXACT_VALUES", 20)
    sizes = []
    real = describe._ordered
    monkeypatch.setattr(describe, "_ordered", lambda df, n: sizes.append(df.count()) or real(df, n))
    rng = random.Random(4)
    n = 30_000
    _check(
        spark,
        pd.DataFrame(
            {
                "uniform": [rng.random() for _ in range(n)],
                "log-normal": [rng.lognormvariate(0, 5) for _ in range(n)],
                "few values": [rng.choice([0, 0, 0, 1, 2, 9]) for _ in range(n)],
                "one value": [3] * n,
                "infinite": [float("-inf")] * 5 + [rng.gauss(0, 1) for _ in range(n - 5)],
            }
        ).drop(columns="infinite"),
    )
    assert sizes[0] < n / 10


def test_a_sketch_that_errs_changes_nothing(spark, monkeypatch):
    """Bounds without the rank are found out by counting."""
    monkeypatch.setattr(describe, "EXACT_VALUES", 20)
    monkeypatch.setattr(describe, "SKETCH_ERROR", -0.2)
    rng = random.Random(5)
    _check(spark, pd.DataFrame({"x": [rng.random() for _ in range(3000)]}))


def test_ranks_that_meet_in_one_range_are_all_kept(spark, monkeypatch):
    """One rank's range closes a round before another's narrows to the same."""
    monkeypatch.setattr(describe, "EXACT_VALUES", 2)
    zeros, more = describe.Range("x", 0.0, 0.0, 0, 6), describe.Range("x", 0.0, 1.0, 0, 40)
    rounds = iter([{zeros: [(1, 2)], more: [(3, 4)]}, {zeros: [(3, 4)]}])
    monkeypatch.setattr(describe, "_narrowed", lambda values, wanted: next(rounds))
    values = spark.createDataFrame([("x", float(i > 5)) for i in range(100)], "feature string, value double")
    totals = [Row(feature="x", count=100, min=0.0, max=1.0)]
    found = describe._quantile_values(values, totals, [0.2, 0.4], 2)
    assert sorted((r["feature"], r["rank"], r["value"]) for r in found.collect()) == [("x", i, 0.0) for i in (1, 2, 3, 4)]
