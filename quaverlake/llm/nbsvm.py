"""Text quality by naive Bayes support vectors: indicators of n-grams, scaled by the log-count ratio of the classes, in a linear hinge-loss model
that is fitted by dual coordinate descent.

The n-grams are single words and pairs of words, and runs of one to four word shapes (capitals, marks, digits, the same word as before).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.llm import words
from quaverlake.llm.sample import labelled_sample
from quaverlake.llm.tables import map_batches

BITS = 20


@dataclass(frozen=True)
class Model:
    """Weight of each hashed n-gram (the ratio is multiplied in), its squared ratio for the length of a row, and the slope and offset of the score."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    offset: float


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What a word looks like, as a small number."""
    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[ends] - sums[starts]

    upper = (data >= 65) & (data <= 90)
    capitals, small = within(upper), within((data >= 97) & (data <= 122))
    marks, digits, size = within(words.KIND[data] == 2), within((data >= 48) & (data <= 57)), ends - starts
    n = len(names)
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True
    same = np.zeros(n, bool)
    same[1:] = (names[1:] == names[:-1]) & ~first[1:]
    second = np.zeros(n, bool)
    second[2:] = (names[2:] == names[:-2]) & ~first[2:] & ~first[1:-1]
    shape = upper[starts] + 2 * ((capitals > 1) & (small == 0)) + 4 * np.minimum(marks, 2) + 12 * (marks == size) + 24 * (digits > 0) + 48 * same + 96 * second
    return words.mix(shape.astype(np.uint64) + np.uint64(0x5A4E))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all rows, each once a row, and the bounds of the rows)."""
    low = words.folded(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts, ends = words.spans(~words.BLANK[data], cut)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    bounds = np.searchsorted(starts, offsets)
    names = words.Rolling(low).names(starts, ends)
    shape = _shapes(data, starts, ends, names, bounds)
    keys = []
    for kind, n in ((names, 1), (names, 2), (shape, 1), (shape, 2), (shape, 3), (shape, 4)):
        got, at = words.ngrams(kind, bounds, n)
        keys.append((words.row_of(at) << BITS) | (got >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(keys))
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(offsets)))


def _ratios(sample: DataFrame) -> np.ndarray:
    """The log-count ratio of each hashed n-gram over the sample: a table of fixed size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy() > 0
            for first, data, offsets in words.text_slices(batch.column(0)):
                got, bounds = features(data, offsets)
                good = np.repeat(label[first:first + len(bounds) - 1], np.diff(bounds))
                for kind in (0, 1):
                    total[kind] += np.bincount(got[good == kind], minlength=1 << BITS)
        held = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[0][held]), pa.array(total[1][held])], ["feature", "poor", "good"])

    rows = map_batches(sample, ["text", "label"], work, "feature long, poor long, good long").groupBy("feature").agg(F.sum("poor").alias("poor"), F.sum("good").alias("good")).toArrow()
    counts = np.ones((2, 1 << BITS))
    at = np.asarray(rows.column("feature"))
    counts[0, at] += np.asarray(rows.column("poor"))
    counts[1, at] += np.asarray(rows.column("good"))
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, width: int, *, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (a bias last) of least ``|w|^2 / 2 + cost * sum hinge(sign * w.x)`` by dual coordinate descent, rows in a new order each round."""
    w = np.zeros(width + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                w[-1] += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w


def _calibrated(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, with the usual targets that stay off 0 and 1."""
    n1, n0 = int(good.sum()), int((~good).sum())
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 0.5 + 0.5 * np.tanh((a * margin + b) / 2)
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum() + 1e-3 * b])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def fit(sample: DataFrame, *, cost: float = 1.0, blend: float = 0.25) -> Model:
    """Fits a sample of (text, label); four of five rows give the weights, the fifth the calibration.

    The weight of each n-gram of those rows is drawn to their mean size by ``1 - blend``, so what it adds comes near its ratio alone, naive
    Bayes; an n-gram that they don't hold weighs nothing. A sample without rows of both labels scores all texts alike, near its label.
    """
    ratio = _ratios(sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in words.text_slices(batch.column(0)):
                got, bounds = features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(offsets) - 1),
                                                  pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(got.astype(np.int32)))], ["label", "features"])

    rows = map_batches(sample, ["text", "label"], work, "label int, features array<int>").toArrow()  # the bounded sample
    good = np.asarray(rows.column("label")) > 0
    lists = rows.column("features").combine_chunks() if len(rows) else pa.array([], pa.list_(pa.int32()))
    bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    if not len(good) or good.all() or not good.any():
        mean = float(good.mean()) if len(good) else 0.5
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log((mean + 0.01) / (1.01 - mean))))
    held = [flat[bounds[i]:bounds[i + 1]] for i in range(len(good))]
    values = [ratio[h] / max(1e-9, float(np.sqrt((ratio[h] ** 2).sum()))) for h in held]
    order = np.argsort([hash_row(h) for h in held], kind="stable")
    probe, train = order[::5], np.delete(order, np.arange(0, len(order), 5))
    if good[train].all() or not good[train].any():
        probe = train = order
    w = descend([held[i] for i in train], [values[i] for i in train], np.where(good[train], 1.0, -1.0), 1 << BITS, cost=cost)
    seen = np.unique(np.concatenate([held[i] for i in train]))
    w[seen] = (1 - blend) * (np.abs(w[seen]).mean() if len(seen) else 0.0) + blend * w[seen]
    margin = np.array([w[held[i]] @ values[i] + w[-1] for i in probe])
    scale = float(np.abs(margin).mean()) or 1.0
    slope, offset = _calibrated(margin / scale, good[probe])
    return Model((w[:-1] * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(w[-1]), slope / scale, offset)


def hash_row(h: np.ndarray) -> int:
    """A number that depends on what a row holds and not on where it came."""
    return int(words.mix(np.array([np.uint64(len(h)) + h.astype(np.uint64).sum()], np.uint64))[0] >> np.uint64(1))


def score(model: Model, column: pa.Array) -> np.ndarray:
    """The score of each text, 0 to 1."""
    out = []
    for _, data, offsets in words.text_slices(column):
        got, bounds = features(data, offsets)
        n, row = len(offsets) - 1, words.row_of(bounds)
        length = np.sqrt(np.bincount(row, model.squares[got], minlength=n)) if len(row) else np.zeros(n)
        total = np.bincount(row, model.weights[got], minlength=n) if len(row) else np.zeros(n)
        margin = total / np.maximum(length, 1e-9) + model.bias
        out.append(0.5 + 0.5 * np.tanh((model.slope * margin + model.offset) / 2))
    return np.concatenate(out) if out else np.zeros(0)


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: Column | None = None, train: Column | None = None, rows: int = 10_000, at_least: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row, from a model fitted on at most ``rows`` labelled ids; ``train`` says which ids (column ``id``) may teach.

    Only the text is an input. A null text is empty; an empty text has the score of no features; repeated rows are scored alike and null ids
    carried; an empty table gives no rows, and without labels every score is 0.5. Other columns aren't read.
    """
    model = fit(labelled_sample(docs, labels, F.col("quality") if label is None else label, rows, id_col=id_col, text_col=text_col, where=train))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = score(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= at_least).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")], work, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
