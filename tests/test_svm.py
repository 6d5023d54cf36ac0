import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors

from postloom.operators import svm

D = 40


@pytest.fixture(scope="module")
def points():
    """Rows of three entries, with labels by sign of a plane; the third label lacks every fifth row."""
    draw = np.random.default_rng(5)
    planes = draw.normal(size=(3, D))
    rows = []
    for i in range(600):
        at = np.sort(draw.choice(D, 8, replace=False))
        value = draw.normal(size=8).round(3)
        score = planes[:, at] @ value
        labels = [float(s > 0) for s in score]
        if i % 5 == 0:
            labels[2] = None
        rows.append((at.tolist(), value.tolist(), labels))
    return rows + [([], [], [0.0, 1.0, None])]


def _frame(spark, points, parts=3):
    schema = "indices array<int>, vals array<double>, labels array<double>"
    return spark.createDataFrame(points, schema).repartition(parts)


def test_predicts_as_separate_fits(spark, points):
    """The one-label class of Spark ML is the reference: rows that either puts far from the plane agree."""
    found = svm.fit_linear_svms(_frame(spark, points), D, 3, max_iter=60)
    vectors = [Vectors.sparse(D, at, value) for at, value, _ in points]
    for label, (weights, bias) in enumerate(found):
        rows = [(v, p[2][label]) for v, p in zip(vectors, points) if p[2][label] is not None]
        model = LinearSVC(maxIter=60, regParam=0.01).fit(spark.createDataFrame(rows, ["features", "label"]).coalesce(1).cache())
        own = np.array([v.toArray() @ weights + bias for v, _ in rows])
        other = np.array([v.toArray() @ model.coefficients.toArray() + model.intercept for v, _ in rows])
        clear = np.minimum(abs(own), abs(other)) > 0.1
        assert clear.mean() > 0.85 and ((own > 0) == (other > 0))[clear].all()
        sign = np.array([2 * y - 1 for _, y in rows])
        deviation = np.array([v.toArray() for v, _ in rows]).std(axis=0, ddof=1)

        def objective(score, w):
            return np.maximum(0, 1 - sign * score).mean() + 0.005 * ((w * deviation) ** 2).sum()

        assert objective(own, weights) < 1.02 * objective(other, model.coefficients.toArray())


def test_one_pass_serves_all_labels(spark, points, monkeypatch):
    passes = []
    whole = svm._summed
    monkeypatch.setattr(svm, "_summed", lambda *a: passes.append(1) or whole(*a))
    alone = []
    for label in range(2):
        one = [(at, value, [labels[label]]) for at, value, labels in points]
        svm.fit_linear_svms(_frame(spark, one), D, 1, max_iter=5)
        alone.append(len(passes))
        passes.clear()
    two = [(at, value, labels[:2]) for at, value, labels in points]
    svm.fit_linear_svms(_frame(spark, two), D, 2, max_iter=5)
    assert len(passes) == max(alone)


def test_sums_do_not_depend_on_partitions_or_slices(spark, points, monkeypatch):
    want = svm.fit_linear_svms(_frame(spark, points, 1), D, 3, max_iter=4)
    monkeypatch.setattr(svm, "SLICE", 7)
    got = svm.fit_linear_svms(_frame(spark, points, 5), D, 3, max_iter=4)
    for (w, b), (v, c) in zip(want, got):
        assert np.allclose(w, v) and np.isclose(b, c)


def test_empty_table_unknown_label_and_wrong_label(spark):
    for rows in ([], [([1], [2.0], [None])]):
        ((weights, bias),) = svm.fit_linear_svms(_frame(spark, rows), D, 1)
        assert not weights.any() and bias == 0.0
    with pytest.raises(ValueError, match="0 or 1"):
        svm.fit_linear_svms(_frame(spark, [([1], [2.0], [3.0])]), D, 1)


def test_rows_are_read_once(spark):
    """Passes read blocks, not the rows again."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema = "indices array<int>, values array<double>, labels array<double>"
    rows = spark.createDataFrame([([i % 3], [1.0 + i % 2], [float(i % 3 > 1), None]) for i in range(40)], schema)
    (weights, _), (other, intercept) = svm.fit_linear_svms(rows.mapInArrow(count, schema), 3, 2, 5)
    assert read.value == 40 and weights[2] > 0 and not other.any() and intercept == 0.0


def test_counts_of_one_travel_as_positions_alone(spark):
    """Two bytes for an entry, and digits of one number for the labels' sums."""
    rows = [(list(range(i % 7, 40, 2)), [1.0] * len(range(i % 7, 40, 2)), [float(i % 2), None]) for i in range(300)]
    frame = _frame(spark, rows, 1).withColumnRenamed("vals", "values")
    blocks = svm._packed(frame, D, 2).collect()
    entries = sum(len(at) for at, _, _ in rows)
    assert sum(len(bytes(x)) for b in blocks for x in b) < 3 * entries + 30 * len(rows)


def test_signed_counts_equal_separate_sums():
    draw = np.random.default_rng(2)
    for n in (1, 3, 900):
        at = [np.sort(draw.choice(D, draw.integers(0, 9), replace=False)) for _ in range(n)]
        ones = svm.Entries(np.array([len(x) for x in at]), np.concatenate(at).astype(np.int64), None)
        slopes = draw.integers(-1, 2, (n, 11)).astype(float)
        most = int(np.bincount(ones.at).max(initial=0))
        found = list(svm._signed_counts(ones, slopes, most, D))
        want = [np.bincount(ones.at, np.repeat(s, ones.n), D) for s in slopes.T]
        assert np.array_equal(found, want)


def test_rarity_equals_weighed_values(spark, points):
    """A position of every row weighs nothing; ones, other and tiny values are met."""
    rows = []
    for i, (at, _, labels) in enumerate(points[:-1]):
        other = dict(zip(at, [1.0, 2.0, 1.0, 1.0, 3.0, 1.0, 1.0, 1e-7])) | {0: 1.0 + i % 3}
        rows.append((sorted(other), [other[k] for k in sorted(other)], labels))
    met = np.bincount([x for at, _, _ in rows for x in at], minlength=D)
    idf = np.log((len(rows) + 1) / (met + 1))
    weighed = [(at, [float(v * idf[k]) for k, v in zip(at, value)], labels) for at, value, labels in rows]
    got = svm.fit_linear_svms(_frame(spark, rows), D, 3, max_iter=5, by_rarity=True)
    want = svm.fit_linear_svms(_frame(spark, weighed), D, 3, max_iter=5)
    for (w, b), (v, c) in zip(got, want):
        assert w[0] == 0 and np.allclose(w, v * idf, atol=1e-6) and np.isclose(b, c, atol=1e-6)
