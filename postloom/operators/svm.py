"""Linear SVMs of several labels, fitted together over shared sparse vectors.

Every label has its own L-BFGS search, a small state on the driver of the size of
the model. One pass over the rows answers the open question of every search, so the
number of passes is that of the label with the most steps, not the sum over labels.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers of a sum that travel in one row.
SLICE = 1 << 17
#: Searches keep this many earlier steps.
MEMORY = 10
#: Rows of a block that the passes read, at most.
BLOCK_ROWS = 1000

_SUMS = "slice int, part binary"


class Entries(NamedTuple):
    """The entries of a block's rows, row by row: how many each has, and their positions; no values if all are 1."""

    n: np.ndarray
    at: np.ndarray
    value: np.ndarray | None

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Per row the sum of its values times the weights at their positions."""
        out = np.zeros(len(self.n))
        met = self.n > 0
        if met.any():
            found = weights[self.at]
            if self.value is not None:
                found *= self.value
            out[met] = np.add.reduceat(found, (np.cumsum(self.n) - self.n)[met])
        return out


class Block(NamedTuple):
    """Some rows: entries of value 1, the other entries, labels by row with NaN for null, and the most rows of a position."""

    ones: Entries
    others: Entries
    labels: np.ndarray
    most: int


def _packed(rows: DataFrame, n_features: int, n_labels: int) -> DataFrame:
    """The rows in blocks of numpy bytes: every pass reads them as they are, without a list for each row.

    Most values are counts of 1, which are not kept.
    """
    at_kind = "<u2" if n_features <= 1 << 16 else "<i4"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                indices, values, labels = (batch.column(i).slice(low, BLOCK_ROWS) for i in range(3))
                n = indices.value_lengths().to_numpy(zero_copy_only=False)
                at, value = indices.flatten().to_numpy(), values.flatten().to_numpy()
                one = value == 1.0
                # how many of the entries before an end are 1
                until = np.append(0, np.cumsum(one))[np.append(0, np.cumsum(n))]
                n_ones = np.diff(until)
                most = np.bincount(at[one]).max(initial=0)
                parts = (
                    n_ones.astype("<i4"),
                    at[one].astype(at_kind),
                    (n - n_ones).astype("<i4"),
                    at[~one].astype(at_kind),
                    value[~one].astype("<f8"),
                    labels.flatten().to_numpy(zero_copy_only=False).astype("<f8"),
                    np.array([most], "<i8"),
                )
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=names)

    names = ["n_ones", "ones", "n_others", "others", "value", "labels", "most"]
    return rows.mapInArrow(pack, ", ".join(f"{x} binary" for x in names))


def _blocks(batch: pa.RecordBatch, n_features: int, n_labels: int) -> Iterator[Block]:
    at_kind = "<u2" if n_features <= 1 << 16 else "<i4"
    kinds = ("<i4", at_kind, "<i4", at_kind, "<f8", "<f8", "<i8")
    for i in range(batch.num_rows):
        n, at, m, to, value, labels, most = (np.frombuffer(c[i].as_buffer(), k) for c, k in zip(batch.columns, kinds))
        yield Block(
            Entries(n, at.astype(np.int64), None),
            Entries(m, to.astype(np.int64), value),
            labels.reshape(-1, n_labels),
            int(most[0]),
        )


def _summed(
    blocks: DataFrame, n_features: int, n_labels: int, shape: tuple[int, int], add: Callable[[Block, np.ndarray], None]
) -> np.ndarray:
    """Sum over all rows of what ``add`` puts into a block of ``shape``.

    A task sends one block, cut into slices; the slices are added up as they
    arrive, so no task holds more than its slices of the block.
    """
    size = shape[0] * shape[1]
    n_slices = -(-size // SLICE)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, met = np.zeros(shape), False
        for batch in batches:
            for one in _blocks(batch, n_features, n_labels):
                met = True
                add(one, block)
        if met:
            flat = block.ravel()
            yield _rows((i, flat[i * SLICE : (i + 1) * SLICE]) for i in range(n_slices))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers = np.frombuffer(part.as_buffer(), dtype="<f8")
                if i in sums:
                    sums[i] += numbers
                else:
                    sums[i] = numbers.copy()
        if sums:
            yield _rows(sums.items())

    slices = blocks.mapInArrow(partial, _SUMS).repartition(min(n_slices, 32), "slice").mapInArrow(total, _SUMS)
    block = np.zeros(n_slices * SLICE)
    # one row for each slice of a block of the model's size
    for row in slices.collect():
        numbers = np.frombuffer(bytes(row.part), dtype="<f8")
        block[row.slice * SLICE : row.slice * SLICE + len(numbers)] = numbers
    return block[:size].reshape(shape)


def _rows(slices) -> pa.RecordBatch:
    numbers, parts = zip(*slices)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(numbers, pa.int32()),
            pa.array([p.astype("<f8", copy=False).tobytes() for p in parts], pa.binary()),
        ],
        names=["slice", "part"],
    )


def _moments(rows: DataFrame, n_features: int, n_labels: int) -> np.ndarray:
    """Per label: sums and sums of squares of each feature, known rows, rows with other labels than 0 and 1.

    A last line has how many rows have each feature, and how many rows there are.
    """

    def add(batch: Block, block: np.ndarray) -> None:
        ones, others, labels, _ = batch
        sums: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def of(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # labels that are known for the same rows share their sums
            if known.tobytes() not in sums:
                mine = np.repeat(known, others.n)
                at, value = others.at[mine], others.value[mine]
                plain = np.bincount(ones.at[np.repeat(known, ones.n)], minlength=n_features)
                sums[known.tobytes()] = tuple(plain + np.bincount(at, x, n_features) for x in (value, value**2))
            return sums[known.tobytes()]

        for label in range(n_labels):
            known = ~np.isnan(labels[:, label])
            block[label, :n_features] += of(known)[0]
            block[label, n_features : 2 * n_features] += of(known)[1]
            block[label, -2] += known.sum()
            block[label, -1] += (known & ~np.isin(labels[:, label], (0.0, 1.0))).sum()
        for at in (ones.at, others.at[others.value != 0]):
            block[-1, :n_features] += np.bincount(at, minlength=n_features)
        block[-1, -2] += len(labels)

    return _summed(rows, n_features, n_labels, (n_labels + 1, 2 * n_features + 2), add)


def _signed_counts(ones: Entries, slopes: np.ndarray, most: int, n_features: int) -> Iterator[np.ndarray]:
    """For each column of ``slopes``, of -1, 0 and 1 by row, their sum over the rows of each position.

    Several columns are digits of one number, exact in a double, so that one count serves them.
    """
    base = 2 << most.bit_length()
    together = max(1, 52 // (base.bit_length() - 1))
    for low in range(0, slopes.shape[1], together):
        digits = slopes[:, low : low + together]
        code = digits @ float(base) ** np.arange(digits.shape[1])
        total = np.bincount(ones.at, np.repeat(code, ones.n), n_features)
        for _ in range(digits.shape[1]):
            rest = np.rint(total / base)
            yield total - rest * base
            total = rest


def _hinge(rows: DataFrame, points: np.ndarray, open_labels: list[int]) -> np.ndarray:
    """Per open label: gradient of the summed hinge loss by weight and intercept, and the loss itself."""
    n_labels, width = points.shape
    held = rows.sparkSession.sparkContext.broadcast(points)

    def add(batch: Block, block: np.ndarray) -> None:
        ones, others, labels, most = batch
        slopes = np.zeros((len(labels), len(open_labels)))
        for k, label in enumerate(open_labels):
            weights = held.value[label]
            known = ~np.isnan(labels[:, label])
            sign = np.where(labels[:, label] > 0.5, 1.0, -1.0)
            score = ones.sums(weights) + others.sums(weights) + weights[-1]
            loss = np.where(known, np.maximum(0.0, 1.0 - sign * score), 0.0)
            slope = slopes[:, k] = np.where(loss > 0, -sign, 0.0)
            block[label, : width - 1] += np.bincount(others.at, others.value * np.repeat(slope, others.n), width - 1)
            block[label, width - 1] += slope.sum()
            block[label, width] += loss.sum()
        for label, counts in zip(open_labels, _signed_counts(ones, slopes, most, width - 1)):
            block[label, : width - 1] += counts

    try:
        return _summed(rows, width - 1, n_labels, (n_labels, width + 1), add)
    finally:
        held.unpersist()


def _direction(gradient: np.ndarray, steps: deque) -> np.ndarray:
    """The two-loop recursion of L-BFGS."""
    d, shares = -gradient, []
    for s, y, sy in reversed(steps):
        share = (s @ d) / sy
        shares.append(share)
        d = d - share * y
    if steps:
        s, y, sy = steps[-1]
        d = d * (sy / (y @ y))
    for (s, y, sy), share in zip(steps, reversed(shares)):
        d = d + (share - (y @ d) / sy) * s
    return d


def search(x: np.ndarray, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS with backtracking: yields points, is sent their loss and gradient, returns the last good point."""
    steps: deque = deque(maxlen=MEMORY)
    loss, gradient = yield x
    for _ in range(max_iter):
        d = _direction(gradient, steps)
        slope = gradient @ d
        if slope >= 0:
            steps.clear()
            d, slope = -gradient, -(gradient @ gradient)
        if slope == 0:
            return x
        length = 1.0 if steps else 1.0 / max(1.0, np.linalg.norm(gradient))
        while True:
            moved = x + length * d
            new_loss, new_gradient = yield moved
            if new_loss <= loss + 1e-4 * length * slope:
                break
            length /= 2
            if length < 1e-8:
                return x
        s, y = moved - x, new_gradient - gradient
        if s @ y > 1e-12:
            steps.append((s, y, s @ y))
        still = abs(loss - new_loss) <= tol * max(abs(loss), abs(new_loss), 1e-12)
        x, loss, gradient = moved, new_loss, new_gradient
        if still:
            return x
    return x


def fit_linear_svms(
    rows: DataFrame,
    n_features: int,
    n_labels: int,
    max_iter: int = 20,
    reg_param: float = 0.01,
    tol: float = 1e-6,
    by_rarity: bool = False,
) -> list[tuple[np.ndarray, float]]:
    """``(coefficients, intercept)`` of each label.

    ``rows`` holds three columns, in this order: positions and values of a sparse
    vector, and an array of ``n_labels`` labels 0 or 1, null where a row takes no
    part in that label's fit. The loss is the mean hinge loss plus the squared
    weights of features scaled to unit deviation. A label without a row gets zeros.
    ``by_rarity`` fits on values times their feature's inverse document frequency over all rows,
    ``log((rows + 1) / (rows with it + 1))``; the coefficients are those of the values as given.
    ``rows`` is read once and kept in blocks of numpy bytes, which are read once for the
    deviations and once for each step of all searches.
    """
    blocks = _packed(rows, n_features, n_labels).persist()
    try:
        return _fitted(blocks, n_features, n_labels, max_iter, reg_param, tol, by_rarity)
    finally:
        blocks.unpersist()


def _fitted(
    rows: DataFrame, n_features: int, n_labels: int, max_iter: int, reg_param: float, tol: float, by_rarity: bool
) -> list[tuple[np.ndarray, float]]:
    """The same over the blocks of the rows."""
    moments = _moments(rows, n_features, n_labels)
    moments, (*met, n_rows, _) = moments[:-1], moments[-1]
    wrong = [i for i in range(n_labels) if moments[i, -1]]
    if wrong:
        raise ValueError(f"Labels must be 0 or 1; other values in those at {wrong}")
    n = np.maximum(moments[:, -2], 1.0)[:, None]
    sums, squares = moments[:, :n_features], moments[:, n_features : 2 * n_features]
    deviation = np.sqrt(np.maximum(squares - sums**2 / n, 0.0) / np.maximum(n - 1, 1.0))
    # a factor of a feature's values leaves them the same at unit deviation, unless it is zero
    factor = np.log((n_rows + 1) / (np.array(met[:n_features]) + 1)) if by_rarity else 1.0
    per_unit = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation * factor > 1e-12)
    scale = np.concatenate([per_unit, np.ones((n_labels, 1))], axis=1)

    points = np.zeros((n_labels, n_features + 1))
    searches = {i: search(points[i].copy(), max_iter, tol) for i in range(n_labels) if moments[i, -2]}
    for i, one in searches.items():
        points[i] = next(one)
    while searches:
        answers = _hinge(rows, points * scale, sorted(searches))
        for i, one in list(searches.items()):
            gradient = answers[i, :-1] / n[i] * scale[i]
            loss = answers[i, -1] / n[i, 0] + 0.5 * reg_param * (points[i, :-1] @ points[i, :-1])
            gradient[:-1] += reg_param * points[i, :-1]
            try:
                points[i] = one.send((loss, gradient))
            except StopIteration as end:
                points[i] = end.value
                del searches[i]
    found = points * scale
    return [(w[:-1], float(w[-1])) for w in found]
