"""Multi-label text classification with Spark ML.

A bundle holds one (vectorizer, classifier) pair per label. Labels trained
together share one vectorizer, so a text is tokenized and counted once for all
of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVCModel
from pyspark.ml.feature import CountVectorizerModel, HashingTF, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.ml.common import _py2java
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.svm import fit_linear_svms
from postloom.schemas import LABEL_PREFIX, TEXT_LABELS

TEXT = "__text"
FEATURES = "__features"


@dataclass(frozen=True)
class TextLabelModels:
    """Label -> vectorizer and label -> classifier, in label order."""

    vectorizers: Mapping[str, PipelineModel]
    classifiers: Mapping[str, LinearSVCModel]

    @property
    def labels(self) -> list[str]:
        return list(self.classifiers)


def _term_stages() -> list[Transformer]:
    """Text -> words and word pairs, as built-in expressions.

    Two steps, so that the words are split once though they are used four times.
    """
    words = r"regexp_extract_all(lower(__text), r'[\p{L}\p{M}\p{N}_]+', 0)"
    n_pairs = "greatest(array_size(__words) - 1, 0)"
    pairs = (
        f"zip_with(slice(__words, 1, {n_pairs}), slice(__words, 2, {n_pairs}), "
        "(a, b) -> concat(a, ' ', b))"
    )
    return [
        SQLTransformer(statement=f"SELECT *, {words} AS __words FROM __THIS__"),
        SQLTransformer(statement=f"SELECT *, concat(__words, {pairs}) AS __terms FROM __THIS__"),
    ]


def _with_text(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn(TEXT, F.coalesce(F.col(text_col), F.lit("")))


def _classifier(spark: SparkSession, label: str, weights: Sequence[float], intercept: float) -> LinearSVCModel:
    svc = spark.sparkContext._jvm.org.apache.spark.ml.classification.LinearSVCModel
    return LinearSVCModel(svc(f"weights_{label}", _py2java(spark.sparkContext, Vectors.dense(weights)), intercept))


def train_text_labels(
    df: DataFrame,
    text_col: str,
    label_cols: Mapping[str, str],
    num_features: int = 1 << 16,
    max_iter: int = 20,
    reg_param: float = 0.01,
) -> TextLabelModels:
    """Fit one linear SVM per label on shared word and word-pair features.

    ``label_cols`` maps a label to its 0/1 column; rows with a NULL label are
    left out of that label's fit. Terms are hashed into ``num_features``
    positions, the size of the model: no term is left out and no vocabulary is
    gathered. Counts are weighed by inverse document frequency, a factor that the
    coefficients contain. All labels are fitted in the same passes over the vectors.
    """
    columns = list(dict.fromkeys(label_cols.values()))
    texts = _with_text(df.where(F.col(text_col).isNotNull()), text_col).select(TEXT, *columns)
    vectorizer = PipelineModel([*_term_stages(), HashingTF(inputCol="__terms", outputCol=FEATURES, numFeatures=num_features)])
    labels = F.array(*[F.col(c).cast("double") for c in columns])
    plain = vectorizer.transform(texts).select(F.unwrap_udt(FEATURES).alias("v"), labels.alias("labels"))
    # texts are split once: the fit keeps its own form of the counts, and weighs them
    vectors = plain.select("v.indices", "v.values", "labels")
    fitted = fit_linear_svms(vectors, num_features, len(columns), max_iter, reg_param, by_rarity=True)
    by_column = dict(zip(columns, fitted))
    return TextLabelModels(
        dict.fromkeys(label_cols, vectorizer),
        {label: _classifier(df.sparkSession, label, *by_column[col]) for label, col in label_cols.items()},
    )


def train_text_label(
    df: DataFrame, text_col: str, label: str, label_col: str, **options: float
) -> TextLabelModels:
    return train_text_labels(df, text_col, {label: label_col}, **options)


def text_labels_from_weights(
    spark: SparkSession, weights: Mapping[str, Mapping[str, float]], intercept: float = 0.0
) -> TextLabelModels:
    """Models with given weights per word or word pair: a label holds where their sum is above ``-intercept``."""
    terms = sorted({t for own in weights.values() for t in own})
    counter = CountVectorizerModel.from_vocabulary(terms, "__terms", FEATURES)
    vectorizer = PipelineModel([*_term_stages(), counter])
    classifiers = {
        label: _classifier(spark, label, [float(own.get(t, 0.0)) for t in terms], intercept)
        for label, own in weights.items()
    }
    return TextLabelModels(dict.fromkeys(weights, vectorizer), classifiers)


def merge_text_models(*bundles: TextLabelModels) -> TextLabelModels:
    vectorizers: dict[str, PipelineModel] = {}
    classifiers: dict[str, LinearSVCModel] = {}
    for bundle in bundles:
        vectorizers.update(bundle.vectorizers)
        classifiers.update(bundle.classifiers)
    return TextLabelModels(vectorizers, classifiers)


def save_text_models(spark: SparkSession, models: TextLabelModels, path: str) -> None:
    """Write every vectorizer once, every classifier, and which belong together."""
    pairs = [(label, models.vectorizers[label].uid) for label in models.labels]
    shared = {models.vectorizers[label].uid: models.vectorizers[label] for label in models.labels}
    for uid, vectorizer in shared.items():
        vectorizer.write().overwrite().save(f"{path}/vectorizers/{uid}")
    for label in models.labels:
        models.classifiers[label].write().overwrite().save(f"{path}/classifiers/{label}")
    spark.createDataFrame(pairs, "label string, vectorizer string").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/labels")


def load_text_models(
    spark: SparkSession, path: str, labels: Sequence[str] = tuple(TEXT_LABELS)
) -> TextLabelModels:
    """Load the (vectorizer, classifier) pair of every label, in the given order."""
    saved = spark.read.schema("label string, vectorizer string").json(f"{path}/labels")
    uids = {r.label: r.vectorizer for r in saved.where(F.col("label").isin(list(labels))).collect()}
    missing = [label for label in labels if label not in uids]
    if missing:
        raise ValueError(f"No saved model for labels: {missing}")
    loaded = {
        uid: PipelineModel.load(f"{path}/vectorizers/{uid}") for uid in dict.fromkeys(uids.values())
    }
    return TextLabelModels(
        {label: loaded[uids[label]] for label in labels},
        {label: LinearSVCModel.load(f"{path}/classifiers/{label}") for label in labels},
    )


def score_text_labels(
    df: DataFrame, text_col: str, models: TextLabelModels, prefix: str = LABEL_PREFIX
) -> DataFrame:
    """Add one ``<prefix><label>`` column per label, NULL where the text is NULL.

    A narrow transform: no shuffle, whatever the number of labels.
    """
    scored = _with_text(df, text_col)
    groups: dict[str, list[str]] = {}
    for label in models.labels:
        groups.setdefault(models.vectorizers[label].uid, []).append(label)
    done: list[str] = []
    for labels in groups.values():
        scored = models.vectorizers[labels[0]].transform(scored)
        for label in labels:
            head = models.classifiers[label].copy()
            head.setFeaturesCol(FEATURES).setPredictionCol(prefix + label).setRawPredictionCol("")
            scored = head.transform(scored)
            done.append(label)
        scored = scored.select(*df.columns, TEXT, *[prefix + label for label in done])
    return scored.select(
        *df.columns,
        *[
            F.when(F.col(text_col).isNotNull(), F.col(prefix + label)).alias(prefix + label)
            for label in models.labels
        ],
    )


def annotate_text(spark: SparkSession, text: str, models: TextLabelModels) -> list[float]:
    """Predictions for a single text, in label order."""
    one = spark.createDataFrame([(text,)], "text string")
    row = score_text_labels(one, "text", models).first()
    return [row[LABEL_PREFIX + label] for label in models.labels]
