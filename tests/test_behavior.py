import pytest

from postloom.operators import user_action_counts
from postloom.schemas import FOLLOW, LIKE, POST, REPOST
from postloom.sources import read_actions_csv

ROWS = [
    ("ann", LIKE),
    ("ann", LIKE),
    ("ann", FOLLOW),
    ("ann", LIKE),
    ("bob", REPOST),
    ("cem", POST),
    ("cem", FOLLOW),
    ("cem", FOLLOW),
    ("cem", REPOST),
]


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts_from_csv(spark, tmp_path):
    path = tmp_path / "actions.csv"
    path.write_text("author,type\n" + "".join(f"{a},{t}\n" for a, t in ROWS))
    out = user_action_counts(read_actions_csv(spark, str(path)))
    assert out.columns == ["author", "posts", "reposts", "follows", "likes"]
    assert _sorted(out) == [
        ("ann", 0, 0, 1, 3),
        ("bob", 0, 1, 0, 0),
        ("cem", 1, 1, 2, 0),
    ]


def test_unknown_kinds_and_missing_authors(spark):
    rows = [("a", "app.bsky.graph.block"), (None, POST), ("NA", POST), ("b", None)]
    out = user_action_counts(spark.createDataFrame(rows, "author string, type string"))
    assert _sorted(out) == [("NA", 1, 0, 0, 0)]


def test_missing_column(spark):
    with pytest.raises(ValueError, match="Missing columns"):
        user_action_counts(spark.createDataFrame([(POST,)], "type string"))


def test_own_action_map(spark):
    df = spark.createDataFrame(ROWS, "author string, type string")
    out = user_action_counts(df, {POST: "written", REPOST: "written", LIKE: "liked"})
    assert _sorted(out) == [
        ("ann", 0, 3), ("bob", 1, 0), ("cem", 2, 0),
    ]


def test_one_shuffle(spark):
    df = spark.createDataFrame(ROWS, "author string, type string")
    plan = user_action_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_empty_input(spark):
    out = user_action_counts(spark.createDataFrame([], "author string, type string"))
    assert out.count() == 0 and len(out.columns) == 5
