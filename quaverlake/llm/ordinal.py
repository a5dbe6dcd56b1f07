"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

One weight vector serves all thresholds: P(grade > k) = sigmoid(weights . features - threshold k), with thresholds in ascending order. The
expected severity is the sum of these over k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm import words
from quaverlake.llm.sample import labelled_sample
from quaverlake.llm.tables import map_batches

#: Features are words and their beginnings of so many bytes, hashed to 22 bits.
BEGINNINGS = (6, 7, 8)
BITS = 22
#: Largest values of a feature: a word's share of the text in percent, and the binary logarithm of one more than how often it occurs.
SHARE, OFTEN = 4.0, 4.0
#: Least chi-square of a feature that the model uses.
LEAST_GAIN = 12.0
#: Grades of a text that is marked toxic, by the percentage of its words that toxic texts alone hold.
BANDS = (2.0, 4.0)


@dataclass(frozen=True)
class Model:
    """``slot`` leads from a hashed feature to its place in ``weights`` (two each: for how often it occurs, and for its share), or to -1."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _items(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row) of every word and beginning, the words of each row, and each feature's word; case is folded and ASCII marks are blanks."""
    low = words.folded(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts, ends = words.spans(words.PLAIN[low], cut)
    bounds = np.searchsorted(starts, offsets)
    names = words.Rolling(low)
    rows = words.row_of(bounds)
    got, where = [names.names(starts, ends)], [np.arange(len(starts))]
    for size in BEGINNINGS:
        enough = ends - starts >= size
        got.append(words.mix(names.names(starts[enough], starts[enough] + size) + np.uint64(size)))
        where.append(np.flatnonzero(enough))
    word = np.concatenate(where)
    return (np.concatenate(got) >> np.uint64(64 - BITS)).astype(np.int64), rows[word], np.diff(bounds), word


def _counted(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) in order, and how often each occurs."""
    both, counts = np.unique((row << BITS) | feature, return_counts=True)
    return both >> BITS, both & ((1 << BITS) - 1), counts


def _presence(sample: DataFrame) -> DataFrame:
    """(feature, clean, toxic): rows of either kind that hold a feature, of those that a toxic row holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            toxic = batch.column(1).to_numpy() > 0
            for first, data, offsets in words.text_slices(batch.column(0)):
                feature, row, _, _ = _items(data, offsets)
                row, feature, _ = _counted(feature, row)
                is_toxic = toxic[first + row]
                for kind in (0, 1):
                    total[kind] += np.bincount(feature[is_toxic == kind], minlength=1 << BITS).astype(np.int32)
        held = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[0][held].astype(np.int64)), pa.array(total[1][held].astype(np.int64))], ["feature", "clean", "toxic"])

    return map_batches(sample, ["text", "label"], work, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _columns(feature: np.ndarray, row: np.ndarray, lengths: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the chosen features only."""
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(features, feature), len(features) - 1)
    hit = features[at] == feature
    row, at, counts = _counted(at[hit], row[hit])
    share = np.minimum(SHARE, 100.0 * counts / lengths[row])
    return np.concatenate([row, row]), np.concatenate([2 * at, 2 * at + 1]), np.concatenate([np.minimum(OFTEN, np.log2(1.0 + counts)), share])


def fit(sample: DataFrame, *, features: int = 4096, rounds: int = 1000, ridge: float = 1e-4, rate: float = 0.05) -> Model:
    """Fits a sample of (text, label), label over 0: toxic. ``features`` is the size of the model, chosen by chi-square.

    Binary labels become grades: 0, or 1 and up by how much of the text is words that (nearly) only toxic rows of the sample hold (``BANDS``).
    A sample without toxic rows gives a model that finds nothing; one with toxic rows only, a model that knows no clean text.
    """
    clean, toxic = (int(x or 0) for x in sample.agg(F.sum((F.col("label") <= 0).cast("long")), F.sum((F.col("label") > 0).cast("long"))).first())
    if not clean or not toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(1 + len(BANDS), -9.0 if toxic else 9.0))
    held = F.col("toxic") + F.col("clean")
    gain = (F.pow(F.col("toxic") * clean - F.col("clean") * toxic, 2) / (held * (clean + toxic - held + 1.0)) * ((clean + toxic) / (clean * toxic))).alias("gain")
    chosen = (_presence(sample).where((F.col("toxic") > 1) & (F.col("toxic") * clean > F.col("clean") * toxic)).select("feature", "clean", "toxic", gain)
              .where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "feature").limit(features).collect())  # at most `features` rows
    names = np.array(sorted(r.feature for r in chosen), np.int64)
    only = {r.feature for r in chosen if r.toxic * clean > 20 * r.clean * toxic and r.toxic * 100 > toxic}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.array(sorted(only), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy()
            for first, data, offsets in words.text_slices(batch.column(0)):
                feature, row, lengths, word = _items(data, offsets)
                _, once = np.unique(np.where(np.isin(feature, marked), word, -1), return_index=True)
                share = 100.0 * np.bincount(row[once[np.isin(feature[once], marked)]], minlength=len(lengths)) / np.maximum(lengths, 1)
                row, column, value = _columns(feature, row, lengths, names)
                grade = np.where(label[first:first + len(lengths)] > 0, 1 + np.searchsorted(BANDS, share, "right"), 0)
                order = np.argsort(row, kind="stable")
                bounds = np.searchsorted(row[order], np.arange(len(lengths) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(grade.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(column[order].astype(np.int32))),
                                                  pa.ListArray.from_arrays(pa.array(bounds), pa.array(value[order]))], ["grade", "columns", "values"])

    rows = map_batches(sample, ["text", "label"], work, "grade int, columns array<int>, values array<double>").toArrow()  # the bounded sample, its few chosen features
    lists = rows.column("columns").combine_chunks()
    counts = np.diff(np.asarray(lists.offsets))
    row, column = np.repeat(np.arange(len(counts)), counts), np.asarray(lists.flatten())
    value = np.asarray(rows.column("values").combine_chunks().flatten())
    return Model(names, *_solve(np.asarray(rows.column("grade")), row, column, value, 2 * len(names), 1 + len(BANDS), rounds, ridge, rate))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(x / 2)


def _solve(grade: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, width: int, steps: int, rounds: int, ridge: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised negative log likelihood, by Adam steps. A threshold is the first plus the gaps up to it."""
    n = len(grade)
    over = np.stack([(grade > k).mean().clip(1e-4, 1 - 1e-4) for k in range(steps)])
    start = np.log1p(-over) - np.log(over)
    spare = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    first, second = np.zeros(len(spare)), np.zeros(len(spare))
    low, high = grade - 1, grade
    for t in range(1, rounds + 1):
        w, gaps = spare[:width], np.exp(spare[width + 1:])
        cuts = spare[width] + np.concatenate(([0.0], np.cumsum(gaps)))
        eta = np.bincount(row, w[column] * value, minlength=n)
        # P(grade) = P(> grade - 1) - P(> grade); with logistic links its logarithm has the gradient 1 - F(low) - F(high) in eta
        above = np.where(low >= 0, _sigmoid(eta - cuts[np.maximum(low, 0)]), 1.0)
        beyond = np.where(high < steps, _sigmoid(eta - cuts[np.minimum(high, steps - 1)]), 0.0)
        p = np.maximum(above - beyond, 1e-12)
        d_above, d_beyond = above * (1 - above) / p, beyond * (1 - beyond) / p
        slope = d_above - d_beyond
        d_cut = np.bincount(np.maximum(low, 0), np.where(low >= 0, -d_above, 0), minlength=steps)[:steps] + np.bincount(np.minimum(high, steps - 1), np.where(high < steps, d_beyond, 0), minlength=steps)[:steps]
        tails = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate([ridge * w - np.bincount(column, slope[row] * value, minlength=width)[:width] / n, -tails[:1] / n, -tails[1:] * gaps / n])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        spare = spare - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return spare[:width], spare[width] + np.concatenate(([0.0], np.cumsum(np.exp(spare[width + 1:]))))


def severity(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(expected severity, P(grade > 0), likeliest grade) of each text."""
    out: list[np.ndarray] = []
    for _, data, offsets in words.text_slices(column):
        feature, row, lengths, _ = _items(data, offsets)
        row, at, value = _columns(feature, row, lengths, model.features)
        eta = np.bincount(row, model.weights[at] * value, minlength=len(lengths)) if len(row) else np.zeros(len(lengths))
        out.append(_sigmoid(eta[:, None] - model.thresholds))
    over = np.concatenate(out) if out else np.zeros((0, len(model.thresholds)))
    chance = np.hstack([np.ones((len(over), 1)), over]) - np.hstack([over, np.zeros((len(over), 1))])
    return over.sum(axis=1), over[:, 0], chance.argmax(axis=1)


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """All columns of ``docs``, then severity (0 to the highest grade), p_toxic, grade and toxic (``p_toxic`` at least ``at_least``).

    Whole texts count. A null or empty text has no features and the model's severity for none; repeated rows are scored alike; an empty table
    gives no rows. A column of ``docs`` with one of these four names is replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("severity", "p_toxic", "grade", "toxic")]
    at = next(i for i, f in enumerate(kept) if f.name == text_col)
    schema = docs.select(*[F.col(f"`{f.name}`") for f in kept]).schema.add("severity", "double").add("p_toxic", "double").add("grade", "integer").add("toxic", "boolean")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, chance, grade = severity(model, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(chance), pa.array(grade.astype(np.int32)), pa.array(chance >= at_least)], schema.names)

    return map_batches(docs, [F.col(f"`{f.name}`") for f in kept], work, schema)


def toxicity_model(docs: DataFrame, labels: DataFrame, *, rows: int = 20_000) -> Model:
    """Fitted on at most ``rows`` ids with a known ``toxic`` mark."""
    return fit(labelled_sample(docs, labels, F.col("toxic"), rows))
