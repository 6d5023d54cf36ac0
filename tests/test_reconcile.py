import pandas as pd

from postloom.operators import reconcile, reconcile_summary, unmatched_rows

LEFT = [("a", "1"), ("a", "1"), ("a", "2"), ("b", None), (None, None)]
RIGHT = [("a", "1"), ("a", "1"), ("a", "1"), ("b", None), ("c", "9"), ("c", "9")]
KEYS = ["author", "post_id"]


def _frames(spark):
    schema = "author string, post_id string"
    return spark.createDataFrame(LEFT, schema), spark.createDataFrame(RIGHT, schema)


def test_sides(spark):
    rows = {(r.author, r.post_id): (r.n_left, r.n_right, r.side) for r in
            reconcile(*_frames(spark), KEYS).collect()}
    assert rows == {
        ("a", "1"): (2, 3, "both"),
        ("a", "2"): (1, 0, "left_only"),
        ("b", None): (1, 1, "both"),
        (None, None): (1, 0, "left_only"),
        ("c", "9"): (0, 2, "right_only"),
    }


def test_summary_equals_pandas_outer_merge(spark):
    merged = pd.DataFrame(LEFT, columns=KEYS).merge(
        pd.DataFrame(RIGHT, columns=KEYS), on=KEYS, how="outer", indicator=True
    )
    want = {k: int(v) for k, v in merged["_merge"].value_counts().items() if v}
    rows = reconcile_summary(*_frames(spark), KEYS).collect()
    assert {r.side: r.n_joined for r in rows} == want
    assert sum(r.n_left for r in rows) == len(LEFT) and sum(r.n_right for r in rows) == len(RIGHT)


def test_unmatched_rows(spark):
    rows = sorted(map(str, unmatched_rows(*_frames(spark), KEYS).collect()))
    assert len(rows) == 4
    assert sum("right_only" in r for r in rows) == 2


def test_products_are_exact_decimals(spark):
    rows = spark.createDataFrame([("k",), ("k",)], "k string")
    out = reconcile_summary(rows, rows, ["k"])
    assert dict(out.dtypes)["n_joined"] == "decimal(38,0)" and out.first().n_joined == 4


def test_one_shuffle(spark):
    plan = reconcile(*_frames(spark), KEYS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_empty_sides(spark):
    left, right = _frames(spark)
    assert reconcile(left.limit(0), right.limit(0), KEYS).count() == 0
    assert {r.side for r in reconcile(left.limit(0), right, KEYS).collect()} == {"right_only"}
