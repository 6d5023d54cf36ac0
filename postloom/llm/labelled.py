"""What the text classifiers share: bounded labelled samples, calibration, scoring."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import release_memory

#: Labelled rows of each class that a model is fitted on, at most (in expectation).
PER_CLASS = 4000
#: Every so many rows of the sample calibrate the scores instead.
CALIBRATE_EVERY = 5


def held_out(id_col: str | Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; false for null ids."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = None,
) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, text, lang, label`` of about ``per_class`` labelled rows of each class, none held out.

    Rows are chosen by a hash of the id, so reruns agree. Only the chosen labels
    (a bounded number) are broadcast. A repeated id counts once. Also returns how many
    labelled rows each class has.
    """
    usable = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.lit(0)
    for value, n in sizes.items():
        share = F.when(F.col("label") == value, min(1 << 30, (per_class << 30) // n)).otherwise(share)
    chosen = F.broadcast(usable.where(spread < share))
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang")).join(
        chosen, "doc_id"
    )
    return rows.groupBy("doc_id").agg(
        F.min("text").alias("text"), F.min("lang").alias("lang"), F.max("label").alias("label")
    ), sizes


def fit_in_task(
    sample: DataFrame,
    sizes: dict[int, int],
    fit: Callable[[list, list, np.ndarray, dict[int, int]], dict[str, np.ndarray]],
) -> dict[str, np.ndarray]:
    """Run ``fit(texts, languages, labels, sizes)`` on the whole bounded sample in one task; the model comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            table = pa.Table.from_batches(batches).sort_by("doc_id")
            out = io.BytesIO()
            np.savez(
                out,
                **fit(
                    table.column("text").to_pylist(),
                    table.column("lang").to_pylist(),
                    table.column("label").to_numpy().astype(np.int64),
                    sizes,
                ),
            )
            yield pa.RecordBatch.from_pydict({"model": pa.array([out.getvalue()], pa.binary())})
            del batches, table, out
        release_memory()

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    if row is None:
        return {}
    with np.load(io.BytesIO(row["model"])) as stored:
        return {k: stored[k] for k in stored.files}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def class_weights(labels: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """What each sample row stands for, so that classes weigh as among all labelled rows; sums to one."""
    weight = np.ones(len(labels))
    for value, n in sizes.items():
        weight[labels == value] = n / max(1, (labels == value).sum())
    return weight / max(weight.sum(), 1e-9)


def fit_scale(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by damped Newton steps."""
    y = labels * 0.98 + 0.01
    x = np.stack([margins / max(np.abs(margins).max(), 1e-9), np.ones(len(margins))])

    def loss(at: np.ndarray) -> float:
        z = at @ x
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 5e-5 * at[0] ** 2)

    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = sigmoid(at @ x)
        gradient = x @ (weight * (p - y)) + np.array([1e-4 * at[0], 0])
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return max(float(at[0]), 1e-3) / max(float(np.abs(margins).max()), 1e-9), float(at[1])


def scores(model: dict[str, np.ndarray], margins: np.ndarray) -> np.ndarray:
    """Six digits: how texts are batched moves later ones."""
    return np.round(sigmoid(model["scale"][0] * np.asarray(margins, dtype=np.float64) + model["scale"][1]), 6)


def score_texts(
    rows: DataFrame, model: dict[str, np.ndarray], margins: Callable[[dict, list], np.ndarray], keep: list[str]
) -> DataFrame:
    """``keep`` columns and ``score`` for rows whose first column is the text.

    The model is a broadcast of a size that its parameters fix. Without a model (no labelled rows
    of both classes) every score is 0.5.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(0).to_pylist()
                if own:
                    score = scores(own, margins(own, texts))
                else:
                    score = np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(score.astype(np.float64))], names=[*keep, "score"]
                )

    fields = [f"{n} {f.dataType.simpleString()}" for n, f in zip(keep, rows.schema.fields[1:])]
    return rows.mapInArrow(run, ", ".join([*fields, "score double"]))
