"""Quality classifier: a linear hinge-loss model on n-grams scaled by log-count ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import mix64, window_hashes, word_hashes
from postloom.llm.labelled import (
    CALIBRATE_EVERY,
    PER_CLASS,
    class_weights,
    fit_in_task,
    fit_scale,
    held_out,
    labelled_sample,
    score_texts,
)

DIMENSIONS = 1 << 20
THRESHOLD = 0.7
#: Cost of a margin violation, and passes over the sample.
COST = 1.0
PASSES = 12

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
# upper case, lower case and non-ASCII letters, digits; any other byte is its own class
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 1, 2, 2, 3


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's classes of characters, runs of one class once."""
    kind = _SHAPE[data]
    first = np.ones(len(data), dtype=bool)
    first[1:] = kind[1:] != kind[:-1]
    first[starts] = True
    inside = np.flatnonzero(first)
    a, b = np.searchsorted(inside, starts), np.searchsorted(inside, ends)
    return word_hashes(kind[inside], a, b)


def indicators(text: str | None) -> np.ndarray:
    """The distinct n-grams of a text as positions: words and pairs of words; shapes alone, in pairs and threes.

    A word is a run without white space. Its shape also says whether it repeats the word before.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, dtype=np.int64)
    words = word_hashes(data, starts, ends)
    shapes = _shapes(data, starts, ends)
    again = np.zeros(len(words), dtype=np.uint64)
    again[1:] = words[1:] == words[:-1]
    shapes = mix64(shapes * np.uint64(2) + again + np.uint64(77))
    grams = [words, window_hashes(words, 2), shapes, window_hashes(shapes, 2), window_hashes(shapes, 3)]
    salted = np.concatenate([mix64(g + np.uint64(i)) for i, g in enumerate(grams)])
    return np.unique((salted & np.uint64(DIMENSIONS - 1)).astype(np.int64))


def count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of each n-gram's share in the two classes, counting documents, plus one."""
    counts = np.ones((2, DIMENSIONS))
    for row, label in zip(rows, labels):
        counts[label, row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def _scaled(row: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[row]
    return values / max(np.sqrt(values @ values), 1e-9)


def fit_hinge(
    rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: float = COST, passes: int = PASSES
) -> np.ndarray:
    """Weights (and a constant, last) of the L1-loss support vector machine, by dual coordinate descent."""
    weights = np.zeros(DIMENSIONS + 1)
    signs = labels * 2.0 - 1
    # both classes weigh the same
    limits = np.where(labels == 1, cost / (2 * labels.mean()), cost / (2 * (1 - labels.mean())))
    dual = np.zeros(len(rows))
    squares = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(0)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            margin = weights[rows[i]] @ values[i] + weights[-1]
            new = min(max(dual[i] - (signs[i] * margin - 1) / squares[i], 0.0), limits[i])
            change = (new - dual[i]) * signs[i]
            if change:
                weights[rows[i]] += change * values[i]
                weights[-1] += change
                dual[i] = new
                moved = max(moved, abs(change))
        if moved < 1e-3:
            break
    return weights


def _margins(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        row = indicators(text)
        out[i] = _scaled(row, model["ratios"]) @ model["weights"][row] + model["weights"][-1]
    return out


def fit_quality(texts: list, _langs: list, labels: np.ndarray, sizes: dict[int, int]) -> dict[str, np.ndarray]:
    """Log-count ratios, weights and the scale of scores; nothing if a class is missing."""
    calibrate = np.arange(len(labels)) % CALIBRATE_EVERY == 0
    if len(np.unique(labels[~calibrate])) < 2:
        return {}
    rows = [indicators(t) for t in texts]
    train = np.flatnonzero(~calibrate)
    ratios = count_ratios([rows[i] for i in train], labels[train])
    values = [_scaled(rows[i], ratios) for i in train]
    weights = fit_hinge([rows[i] for i in train], values, labels[train])
    margins = np.array([_scaled(r, ratios) @ weights[r] + weights[-1] for r in rows])
    use = calibrate if len(np.unique(labels[calibrate])) == 2 else ~calibrate
    return {
        "ratios": ratios.astype(np.float32),
        "weights": weights.astype(np.float32),
        "scale": np.array(fit_scale(margins[use], labels[use], class_weights(labels[use], sizes))),
    }


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    threshold: float = THRESHOLD,
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Indicators of word and word-shape n-grams, hashed into ``DIMENSIONS``, are
    scaled by their log-count ratios between the classes, made unit length, and
    fitted with a linear hinge-loss model by dual coordinate descent, on about
    ``per_class`` labelled rows of each class that are not held out. A fifth of the sample, not
    fitted on, sets the logistic curve from margins to scores. Only the text is an input of a score.

    Null and empty texts get the score of a text without n-grams. Null ids are not held out. Repeated rows give
    equal rows; other columns are ignored. Without labels of both classes
    every score is 0.5; an empty table gives an empty result.
    """
    sample, sizes = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    model = fit_in_task(sample, sizes, fit_quality)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    scored = score_texts(rows, model, _margins, ["doc_id"])
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
