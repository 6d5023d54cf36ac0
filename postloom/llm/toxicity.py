"""Toxicity: a convolutional text classifier over hashed word embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import SpanHashes, mix64, normal_bytes, text_chunks, word_hashes, word_spans
from postloom.llm.labelled import (
    CALIBRATE_EVERY,
    PER_CLASS,
    class_weights,
    fit_in_task,
    fit_scale,
    held_out,
    labelled_sample,
    score_texts,
    scores,
    sigmoid,
)

BUCKETS = 1 << 17
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
THRESHOLD = 0.3
PASSES = 8
BATCH = 32
RATE = 0.1
#: Words of the short clean pieces that training adds, below this.
SHORT = 12
#: Spread of new embeddings, and where sums of squared gradients begin.
START = 0.05
FIRST = np.float32(1e-6)
#: Labelled rows of each class that a language needs for a threshold of its own.
LANGUAGE_ROWS = 10

PREFIXES = (3, 4, 5, 6, 7)
SUFFIXES = (3, 4, 5)
PADS = max(WIDTHS) - 1


#: Distinct words whose features are made at a time.
WORDS_AT_ONCE = 100_000


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Embedding rows of each word: of the whole, its beginnings and its ends; ``BUCKETS`` where it is too short."""
    out = np.full((len(words), 1 + len(PREFIXES) + len(SUFFIXES)), BUCKETS, dtype=np.int32)
    mask = np.uint64(BUCKETS - 1)
    out[:, 0] = (mix64(words) & mask).astype(np.int32)
    for low in range(0, len(words), WORDS_AT_ONCE):
        s, n = starts[low : low + WORDS_AT_ONCE], (ends - starts)[low : low + WORDS_AT_ONCE]
        to = np.cumsum(n)
        hashes = SpanHashes(data[np.repeat(s - (to - n), n) + np.arange(int(to[-1]))])
        for column, (kind, size) in enumerate([*((0, x) for x in PREFIXES), *((1, x) for x in SUFFIXES)], start=1):
            long = np.flatnonzero(n >= size)
            a = (to - n)[long] if kind == 0 else to[long] - size
            part = mix64(hashes.of(a, a + size) + np.uint64(column))
            out[low + long, column] = (part & mask).astype(np.int32)
    return out


def read_words(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words, each text's words as their numbers with pads after, and where texts start.

    The number past the last word is the pad.
    """
    data = np.frombuffer(b" ".join(held), dtype=np.uint8)
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    distinct, first, number = np.unique(words, return_index=True, return_inverse=True)
    features = _features(data, starts[first], ends[first], distinct)
    lengths = np.array([len(x) + 1 for x in held], dtype=np.int64)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    counts = np.diff(bounds)
    # every text has a window, if only of pads
    begins = np.concatenate(([0], np.cumsum(counts + PADS + 1)))
    layout = np.full(int(begins[-1]), len(distinct), dtype=np.int64)
    layout[np.repeat(begins[:-1] - bounds[:-1], counts) + np.arange(len(words))] = number
    return features, layout, begins


def _embed(table: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Sum of the rows over the root of their number; the last row of the result is the pad's."""
    n = np.sqrt((features < BUCKETS).sum(axis=1, keepdims=True))
    out = np.zeros((len(features) + 1, table.shape[1]), dtype=np.float32)
    for column in features.T:
        out[:-1] += table[column]
    out[:-1] /= n.astype(np.float32)
    return out


def _windows(layout: np.ndarray, begins: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start, and the first window of each text: at each word, and at the first pad of an empty text."""
    real = layout != pad
    real[begins[:-1]] = True
    at = np.flatnonzero(real)
    return at, np.searchsorted(at, begins[:-1])


def _convolve(embedded: np.ndarray, layout: np.ndarray, at: np.ndarray, filters: list[np.ndarray]) -> list[np.ndarray]:
    """For each width the responses at every window; words are projected once, then added up along the text."""
    numbers = [layout[at + j] for j in range(max(WIDTHS))]
    out = []
    for width, weights in zip(WIDTHS, filters):
        total = np.take(embedded @ weights[0], numbers[0], axis=0)
        for j in range(1, width):
            total += np.take(embedded @ weights[j], numbers[j], axis=0)
        out.append(total)
    return out


def _margins(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    filters = [model[f"filter{w}"] for w in WIDTHS]
    out = []
    for _, held in text_chunks(texts):
        features, layout, begins = read_words(held)
        at, firsts = _windows(layout, begins, len(features))
        responses = _convolve(_embed(model["table"], features), layout, at, filters)
        pooled = np.concatenate([np.maximum.reduceat(r, firsts, axis=0) for r in responses], axis=1)
        hidden = np.maximum(pooled + model["bias"], 0)
        out.append(hidden @ model["out"][:-1] + model["out"][-1])
    return np.concatenate(out) if out else np.empty(0)


class _Adagrad:
    def __init__(self, shape: tuple[int, ...]):
        self.seen = np.full(shape, FIRST, dtype=np.float32)

    def step(self, values: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        self.seen[at] += gradient**2
        values[at] -= RATE * gradient / np.sqrt(self.seen[at])


def fit_toxicity(texts: list, langs: list, labels: np.ndarray, sizes: dict[int, int]) -> dict[str, np.ndarray]:
    """Embeddings, filters, output weights, scale of scores and thresholds; nothing if a class is missing."""
    calibrate = np.arange(len(labels)) % CALIBRATE_EVERY == 0
    train = np.flatnonzero(~calibrate)
    if len(np.unique(labels[train])) < 2:
        return {}
    rng = np.random.default_rng(0)
    table = rng.normal(0, START, (BUCKETS + 1, SIZE)).astype(np.float32)
    table[BUCKETS] = 0
    filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
    out = np.concatenate([rng.normal(0, 0.3, len(bias)), [0]]).astype(np.float32)
    rates = {"table": _Adagrad(table.shape), "bias": _Adagrad(bias.shape), "out": _Adagrad(out.shape)}
    rates |= {w: _Adagrad(f.shape) for w, f in zip(WIDTHS, filters)}
    vocabulary, layouts, edges = read_words([normal_bytes(t) for t in texts])
    positives = labels[train].mean()
    for _ in range(PASSES):
        order = rng.permutation(train)
        for low in range(0, len(order), BATCH):
            batch = order[low : low + BATCH]
            parts = [layouts[edges[i] : edges[i + 1]] for i in batch]
            # a few words of a clean text, or none, are clean too
            pads = np.full(PADS + 1, len(vocabulary))
            for i in batch[labels[batch] == 0]:
                own = layouts[edges[i] : edges[i + 1] - PADS - 1]
                low_word = rng.integers(0, len(own) + 1)
                parts.append(np.concatenate([own[low_word : low_word + rng.integers(0, SHORT)], pads]))
            begins = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            used, layout = np.unique(np.concatenate([*parts, [len(vocabulary)]]), return_inverse=True)
            features = vocabulary[used[:-1]]
            embedded = _embed(table, features)
            windows, firsts = _windows(layout[:-1], begins, len(features))
            responses = _convolve(embedded, layout, windows, filters)
            ends = np.append(firsts[1:], len(windows))
            top = [np.stack([a + r[a:b].argmax(axis=0) for a, b in zip(firsts, ends)]) for r in responses]
            pooled = np.concatenate([np.take_along_axis(r, t, axis=0) for r, t in zip(responses, top)], axis=1)
            hidden = np.maximum(pooled + bias, 0)
            y = np.concatenate([labels[batch], np.zeros(len(parts) - len(batch), dtype=np.int64)])
            weight = np.where(y == 1, 0.5 / positives, 0.25 / (1 - positives)) / len(batch)
            error = ((sigmoid(hidden @ out[:-1] + out[-1]) - y) * weight).astype(np.float32)
            back = error[:, None] * out[None, :-1] * (hidden > 0)
            to_words = np.zeros((len(embedded), SIZE), dtype=np.float32)
            for k, (width, weights, t) in enumerate(zip(WIDTHS, filters, top)):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                gradient = np.empty_like(weights)
                for j in range(width):
                    word = layout[windows[t] + j]
                    gradient[j] = np.einsum("dfs,df->sf", embedded[word], own)
                    live = own != 0
                    np.add.at(to_words, word[live], own[live][:, None] * weights[j].T[np.nonzero(live)[1]])
                rates[width].step(weights, gradient)
            rates["out"].step(out, np.concatenate([hidden.T @ error, [error.sum()]]))
            rates["bias"].step(bias, back.sum(axis=0))
            moved = np.flatnonzero(np.abs(to_words[:-1]).max(axis=1) > 0)
            share = to_words[moved] / np.sqrt((features[moved] < BUCKETS).sum(axis=1, keepdims=True))
            rows = features[moved].ravel()
            every = np.repeat(share, features.shape[1], axis=0)[rows < BUCKETS]
            at, number = np.unique(rows[rows < BUCKETS], return_inverse=True)
            summed = np.zeros((len(at), SIZE), dtype=np.float32)
            np.add.at(summed, number, every)
            rates["table"].step(table, summed, at)
    # rows that training never moved stay neutral
    table[rates["table"].seen.max(axis=1) <= FIRST] = 0
    model = {"table": table, "bias": bias, "out": out} | {f"filter{w}": f for w, f in zip(WIDTHS, filters)}
    use = np.flatnonzero(calibrate) if len(np.unique(labels[calibrate])) == 2 else train
    margins = _margins(model, [texts[i] for i in use])
    weight = class_weights(labels[use], sizes)
    scale = fit_scale(margins, labels[use], weight)
    found = scores({"scale": np.array(scale)}, margins)
    names, thresholds = _thresholds(found, labels[use], weight, [langs[i] for i in use])
    return model | {"scale": np.array(scale), "languages": names, "thresholds": thresholds}


def best_threshold(found: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best F1; the middle of the gap it may lie in."""
    order = np.argsort(-found, kind="stable")
    hits = np.cumsum((labels * weight)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (labels * weight).sum())
    ends = np.append(found[order][1:] != found[order][:-1], True)
    best = int(np.argmax(np.where(ends, f1, -1)))
    low = found[order][best + 1] if best + 1 < len(order) else 0.0
    return float((found[order][best] + low) / 2)


def _thresholds(
    found: np.ndarray, labels: np.ndarray, weight: np.ndarray, langs: list
) -> tuple[np.ndarray, np.ndarray]:
    """One threshold for each language with enough rows of both classes; the first, of name '', is for all others."""
    # with few labels the best F1 may flag everything: never below the plain threshold
    names, values = [""], [max(THRESHOLD, best_threshold(found, labels, weight))]
    langs = np.array([x or "" for x in langs])
    for lang in sorted(set(langs) - {""}):
        own = langs == lang
        if min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= LANGUAGE_ROWS:
            names.append(str(lang))
            values.append(max(THRESHOLD, best_threshold(found[own], labels[own], weight[own])))
    return np.array(names), np.array(values)


def _limits(model: dict[str, np.ndarray]) -> dict[str, float]:
    return dict(zip(model["languages"].tolist(), model["thresholds"].tolist())) if model else {"": THRESHOLD}


def fit_toxicity_model(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, np.ndarray]:
    """The model, fitted on about ``per_class`` labelled rows of each class, none held out."""
    sample, sizes = labelled_sample(docs, labels, label, per_class, id_col, text_col, lang_col)
    return fit_in_task(sample, sizes, fit_toxicity)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    threshold: float = THRESHOLD,
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``doc_id, held_out, score, predicted, lang_threshold, flagged`` of every whole text.

    A word's embedding sums hashed rows for the word, its beginnings
    and its ends. Filters over one, two and three words are max-pooled over the
    whole text into a logistic output; everything is trained in numpy on about
    ``per_class`` labelled rows of each class that are not held out. A fifth of
    that sample, not fitted on, sets the scale of scores and for each language the
    threshold of the best F1. ``predicted`` uses ``threshold``, ``flagged`` the
    language's threshold (the common one for unknown or null languages). Only the text is an input of a score.

    Null and empty texts get the score of a text without words. Null ids are
    not held out. Repeated rows give equal rows; other columns are ignored.
    Without labels of both classes every score is 0.5 and the threshold ``threshold``; an
    empty table gives an empty result.
    """
    model = fit_toxicity_model(docs, labels, label, per_class, id_col, text_col, lang_col)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    limits = _limits(model)
    limit = F.lit(limits[""])
    for lang, value in limits.items():
        if lang:
            limit = F.when(F.col("lang") == lang, value).otherwise(limit)
    return score_texts(rows, model, _margins, ["doc_id", "lang"]).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        limit.alias("lang_threshold"),
        (F.col("score") >= limit).alias("flagged"),
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", **settings
) -> DataFrame:
    """The rows, with all their columns, whose score stays below their language's threshold.

    Null and empty texts stay; without a model all rows do.
    """
    model = fit_toxicity_model(docs, labels, text_col=text_col, lang_col=lang_col, **settings)
    if not model:
        return docs
    limits = _limits(model)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_text, at_lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(at_text).to_pylist()
                score = scores(own, _margins(own, texts))
                limit = np.array([limits.get(x, limits[""]) for x in part.column(at_lang).to_pylist()])
                yield part.filter(pa.array((score < limit) | np.array([not t for t in texts])))

    return docs.mapInArrow(run, docs.schema)
