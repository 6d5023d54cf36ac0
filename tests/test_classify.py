import numpy as np
import pytest

from postloom.operators import (
    annotate_text,
    load_text_models,
    merge_text_models,
    save_text_models,
    score_text_labels,
    text_labels_from_weights,
    train_text_label,
    train_text_labels,
)
from postloom.schemas import TEXT_LABELS

ROWS = [
    ("rain again and a grey road", 1, 0),
    ("grey clouds, so much rain", 1, 0),
    ("rain on the road at noon", 1, 1),
    ("a warm day at the beach", 0, 1),
    ("warm sand and a blue sea", 0, 0),
    ("the beach is warm at noon", 0, 1),
] * 3


@pytest.fixture(scope="module")
def training(spark):
    return spark.createDataFrame(ROWS, "text string, down int, other int").coalesce(1)


@pytest.fixture(scope="module")
def models(training):
    columns = {label: ("down", "other")[i % 2] for i, label in enumerate(TEXT_LABELS)}
    return train_text_labels(training, "text", columns, num_features=512, max_iter=5)


def test_one_column_per_label(spark, models):
    df = spark.createDataFrame(
        [(1, "A warm beach."), (2, "Rain on a grey road."), (3, None), (4, "")],
        "id int, text string",
    )
    out = score_text_labels(df, "text", models)
    columns = [f"DASS_{label}" for label in TEXT_LABELS]
    assert out.columns == ["id", "text", *columns]
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 4
    assert rows[1].DASS_anxiety == 0.0 and rows[2].DASS_anxiety == 1.0
    assert all(rows[3][c] is None for c in columns)
    assert all(rows[4][c] in (0.0, 1.0) for c in columns)


def test_prediction_is_the_sign_of_the_linear_score(spark, models):
    texts = spark.createDataFrame([(t,) for t, *_ in ROWS[:6]], "text string")
    vectors = models.vectorizers["stress"].transform(texts.selectExpr("text", "text AS __text"))
    model = models.classifiers["stress"]
    weights, bias = np.array(model.coefficients.toArray()), model.intercept
    want = {r.text: float(r["__features"].toArray() @ weights + bias > 0) for r in vectors.collect()}
    got = {r.text: r.DASS_stress for r in score_text_labels(texts, "text", models).collect()}
    assert got == want


def test_single_text_in_label_order(spark, models):
    result = annotate_text(spark, "Rain and a warm sea.", models)
    assert isinstance(result, list) and len(result) == len(TEXT_LABELS)
    frame = spark.createDataFrame([("Rain and a warm sea.",)], "text string")
    assert result == list(score_text_labels(frame, "text", models).drop("text").first())


def test_save_and_load(spark, models, tmp_path):
    path = str(tmp_path / "models")
    save_text_models(spark, models, path)
    assert len(list((tmp_path / "models" / "vectorizers").iterdir())) == 1
    loaded = load_text_models(spark, path)
    assert loaded.labels == TEXT_LABELS
    assert len({id(v) for v in loaded.vectorizers.values()}) == 1
    text = "grey sea but warm sand"
    assert annotate_text(spark, text, loaded) == annotate_text(spark, text, models)
    assert load_text_models(spark, path, ["stress", "anxiety"]).labels == ["stress", "anxiety"]
    with pytest.raises(ValueError, match="anger"):
        load_text_models(spark, path, ["anger"])


def test_labels_with_their_own_vectorizers(spark, training):
    a = train_text_label(training, "text", "a", "down", num_features=64, max_iter=3)
    b = train_text_label(training, "text", "b", "other", num_features=32, max_iter=3)
    both = merge_text_models(a, b)
    df = training.select("text").distinct()
    out = score_text_labels(df, "text", both, prefix="p_")
    alone = score_text_labels(df, "text", b, prefix="p_")
    assert out.columns == ["text", "p_a", "p_b"]
    assert {r.text: r.p_b for r in out.collect()} == {r.text: r.p_b for r in alone.collect()}


def test_terms_are_words_and_pairs(spark, models):
    df = spark.createDataFrame([("So ÉTÉ, so!",), ("one",), ("",)], "__text string")
    for stage in models.vectorizers["stress"].stages[:2]:
        df = stage.transform(df)
    assert [r["__terms"] for r in df.collect()] == [
        ["so", "été", "so", "so été", "été so"], ["one"], [],
    ]


def test_null_labels_are_left_out(spark, training):
    more = training.unionByName(
        spark.createDataFrame([("warm warm warm", None, 1)], training.schema)
    )
    assert train_text_label(more, "text", "a", "down", max_iter=2).labels == ["a"]


def test_shared_vectorizer_runs_once_and_nothing_is_shuffled(spark, models):
    df = spark.createDataFrame([("x",)], "text string")
    plan = score_text_labels(df, "text", models)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("regexp_extract_all") == 1


def test_empty_frame(spark, models):
    out = score_text_labels(spark.createDataFrame([], "text string"), "text", models)
    assert out.count() == 0 and len(out.columns) == 7


def test_given_weights(spark, tmp_path):
    weights = {"up": {"warm": 2.0, "grey road": -3.0}, "down": {"grey": 1.0}}
    save_text_models(spark, text_labels_from_weights(spark, weights), str(tmp_path / "m"))
    loaded = load_text_models(spark, str(tmp_path / "m"), ["up", "down"])
    df = spark.createDataFrame([("Warm grey road",), ("warm warm grey road",), ("sea",), (None,)], "t string")
    got = [(r.DASS_up, r.DASS_down) for r in score_text_labels(df, "t", loaded).collect()]
    assert got == [(0.0, 1.0), (1.0, 1.0), (0.0, 0.0), (None, None)]


def test_nothing_stays_cached_after_a_failed_fit(spark, training):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with pytest.raises(Exception):
        train_text_label(training.withColumn("down", training["down"] + 5), "text", "a", "down", max_iter=2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
