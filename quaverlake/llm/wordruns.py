"""Periodic runs of words: Lyndon words under both orders from the grouping phase of a suffix sort, extended by common extensions into runs.

Names of words are 64-bit hashes; equal words have equal names, different ones of one text differ but for chance.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.tables import map_batches
from quaverlake.llm.words import BLANK, SLICE_BYTES, Rolling, mix, ngrams, spans, text_slices

#: Shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a window. A run of 24 words and three periods holds each of its words in a window that occurs twice, one period apart.
WINDOW = 8
#: For each row that is to be read in another order of words, its place among the rows and the places of the words.
Rearrange = Callable[[list, np.ndarray], list[tuple[int, np.ndarray]]]

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from each place on. ``ranks`` are positive; a 0 ends a text, and there is one at either end.

    The first phase of a sort of suffixes by groups: suffixes that begin with the same Lyndon word form a group, ordered by it. From the
    greatest group down, each member looks for the nearest place before it whose suffix is smaller; a place that k members find has a word
    that goes on with k times the group's, so it moves to a new group just above its own. Once a group is taken, its word is final.
    """
    n = len(ranks)
    values, inverse = np.unique(ranks, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    edges = np.searchsorted(inverse[order], np.arange(len(values) + 1))
    members = [order[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
    group = array("i", inverse.astype(np.int32).tobytes())
    word = [1] * len(values)
    below, above = list(range(-1, len(values) - 1)), list(range(1, len(values) + 1))
    before = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
    done = bytearray(n)
    length = array("i", np.zeros(n, np.int32).tobytes())
    g = len(values) - 1
    while g > 0:
        own = [s for s in members[g] if group[s] == g]
        members[g] = ()
        size = word[g]
        for s in own:
            done[s] = 1
            length[s] = size
        found: dict[int, int] = {}
        for s in own:
            p = before[s]
            while done[p]:
                p = before[p]
            x = s
            while before[x] != p:  # those passed on the way lead straight there from now on
                before[x], x = p, before[x]
            if group[p]:
                found[p] = found.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in found.items():
            moved.setdefault((-k, group[p]), []).append(p)
        for k, h in sorted(moved):
            new, up = len(word), above[h]
            word.append(word[h] - k * size)
            members.append(moved[k, h])
            below.append(h)
            above.append(up)
            above[h] = new
            if up < len(below):
                below[up] = new
            for p in moved[k, h]:
                group[p] = new
        g = below[g]
    return np.frombuffer(length, np.int32).astype(np.int64)


class Extensions:
    """How far two places of a sequence of names agree, to the right and to the left, for many pairs at once; 0 stands between texts."""

    def __init__(self, names: np.ndarray, ends: np.ndarray):
        n = len(names)
        up, down = np.full(n, _STEP, np.uint64), np.full(n + 1, _BACK, np.uint64)
        up[:1], down[:1] = 1, 1
        self.names, self.ends = names, ends
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(names + _STEP) * np.multiply.accumulate(up), out=self.sums[1:])
        self.down = np.multiply.accumulate(down)
        #: Of each place, the first separator at or after it and the last before it.
        self.next_end = ends[np.searchsorted(ends, np.arange(n))]
        self.last_end = ends[np.maximum(np.searchsorted(ends, np.arange(n)) - 1, 0)]

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.down[a] == (self.sums[b + n] - self.sums[b]) * self.down[b]

    def _most(self, most: np.ndarray, fits: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (low < high).any():
            half = (low + high + 1) >> 1
            good = fits(half)
            low, high = np.where(good, half, low), np.where(good, high, half - 1)
        return low

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Names in common from a and from b on; a lies before b."""
        return self._most(self.next_end[b] - b, lambda n: self.equal(a, b, n))

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Names in common before a and before b."""
        return self._most(a - self.last_end[a] - 1, lambda n: self.equal(a - n, b - n, n))


def runs_of(names: np.ndarray, ends: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) of the runs, ascending by start and period. ``names``: texts with a separator before, between and after them, at ``ends``.

    ``least_periods`` is at least 3: then a run's Lyndon root under one of the orders stands in it twice in a row as the longest Lyndon word.
    """
    if not len(names):
        return np.zeros((0, 3), np.int64)
    ranks = np.unique(names, return_inverse=True)[1] + 1
    ranks[ends] = 0
    other = ranks.max() + 1 - ranks
    other[ends] = 0
    meet, found = Extensions(names, ends), []
    for order in (ranks, other):
        size = lyndon_lengths(order)
        at = np.flatnonzero(size)
        period = size[at]
        twice = size[at + period] == period
        at, period = at[twice], period[twice]
        same = meet.equal(at, at + period, period)
        at, period = at[same], period[same]
        back = np.maximum(at - period, 0)
        inside = (size[back] == period) & (back == at - period) & meet.equal(back, back + period, np.where(back == at - period, period, 0))
        at, period = at[~inside], period[~inside]
        left, right = meet.left(at, at + period), meet.right(at, at + period)
        found.append(np.stack([at - left, left + period + right, period], axis=1))
    got = np.concatenate(found)
    got = np.unique(got[got[:, 1] >= np.maximum(least_words, least_periods * got[:, 2])], axis=0)
    for k, (start, length, period) in enumerate(got):  # names of stretches agree but for chance; words decide
        odd = np.flatnonzero(names[start:start + length - period] != names[start + period:start + length])
        if len(odd):
            got[k, 1] = odd[0] + period
    got = got[got[:, 1] >= np.maximum(least_words, least_periods * got[:, 2])]
    return got[np.lexsort((got[:, 2], got[:, 0]))]


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """Names of words, a few megabytes at a time; a word longer than that has its name from another hash."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + limit, "right"))
        if last <= first:
            last = first + 1
            out[first] = int.from_bytes(hashlib.blake2b(data[starts[first]:ends[first]], digest_size=8).digest(), "little")
        else:
            base = starts[first]
            out[first:last] = Rolling(data[base:ends[last - 1]]).names(starts[first:last] - base, ends[first:last] - base)
        first = last
    return out


def _repetitive(names: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that windows which occur twice in their row cover."""
    grams, at = ngrams(names, bounds, window)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((grams, rows))
    same = (grams[order[1:]] == grams[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.flatnonzero(twice)
    first = hit - at[rows[hit]] + bounds[rows[hit]]
    depth = np.zeros(len(names) + 1, np.int32)
    np.add.at(depth, first, 1)
    np.add.at(depth, first + window, -1)
    cut = np.zeros(len(names) + 1, bool)
    cut[bounds] = True
    return spans(np.cumsum(depth[:-1]) > 0, cut)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, each followed by a blank but those marked ``last``, and where each word's bytes begin, with the end."""
    sizes = ends - starts + ~last
    places = np.concatenate(([0], np.cumsum(sizes)))
    out = np.full(places[-1], 0x20, np.uint8)
    first = 0
    while first < len(starts):
        stop = max(first + 1, int(np.searchsorted(places, places[first] + limit, "right")) - 1)
        if stop == first + 1:
            out[places[first]:places[first] + ends[first] - starts[first]] = data[starts[first]:ends[first]]
        else:
            lengths = ends[first:stop] - starts[first:stop]
            steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out[np.repeat(places[first:stop], lengths) + steps] = data[np.repeat(starts[first:stop], lengths) + steps]
        first = stop
    return out, places


def _slice(ids: list, data: np.ndarray, offsets: np.ndarray, least_words: int, least_periods: int, window: int, rearrange: Rearrange | None) -> tuple[np.ndarray, list, pa.Array]:
    """(words, runs and the text left) of the rows of one slice."""
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts, ends = spans(~BLANK[data], cut)
    names, bounds = _names(data, starts, ends), np.searchsorted(starts, offsets)
    if rearrange is not None:
        for row, places in rearrange(ids, np.diff(bounds)):
            mine = slice(bounds[row], bounds[row + 1])
            names[mine], starts[mine], ends[mine] = names[mine][places], starts[mine][places], ends[mine][places]
    drop = np.zeros(len(names), bool)
    found: list[list] = [[] for _ in range(len(offsets) - 1)]
    begins, closes = _repetitive(names, bounds, window)
    enough = closes - begins >= least_words
    begins, closes = begins[enough], closes[enough]
    if len(begins):
        lengths = closes - begins
        borders = np.concatenate(([0], np.cumsum(lengths + 1)))
        text = np.zeros(borders[-1] + 1, np.uint64)
        inner = np.repeat(borders[:-1] + 1, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text[inner] = names[inner - np.repeat(borders[:-1] + 1 - begins, lengths)]
        got = runs_of(text, borders, least_words, least_periods)
        part = np.searchsorted(borders, got[:, 0]) - 1
        got[:, 0] += begins[part] - borders[part] - 1
        for (start, length, period), row in zip(got.tolist(), (np.searchsorted(bounds, got[:, 0], "right") - 1).tolist()):
            found[row].append({"start": start - int(bounds[row]), "length": length, "period": period})
            drop[start + period:start + length] = True
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[~drop]
    last = np.append(rows[1:] != rows[:-1], [True] * bool(len(rows)))
    out, places = _joined(data, starts[~drop], ends[~drop], last)
    left = places[np.searchsorted(rows, np.arange(len(bounds)))]
    texts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(out))
    return np.diff(bounds), found, texts


def _find(batches: Iterator[pa.RecordBatch], least_words: int, least_periods: int, window: int, rearrange: Rearrange | None) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for first, data, offsets in text_slices(batch.column(1)):
            ids = batch.column(0).slice(first, len(offsets) - 1)
            counts, found, texts = _slice(ids.to_pylist(), data, offsets, least_words, least_periods, window, rearrange)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(found, kind), texts.cast(pa.string())], ["id", "n_words", "runs", "collapsed"])


def word_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
              rearrange: Rearrange | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) for each row: its periodic runs of words, and its text without what they repeat.

    Words are runs of bytes other than blank and 0x09-0x0D. A run is a stretch with smallest period q, at least ``least_words`` words and
    ``least_periods`` periods (3 or more) that no word beside it extends; ``runs`` has (start, length, period) in words from 0, by start, then period.
    ``collapsed`` joins by one blank the words that no run holds after its first q. Null and empty texts have no words and an empty text left. Every
    row is worked on by itself, repeated rows too; other columns aren't read. ``rearrange`` has the words of some rows read in another order.

    No shuffle: each task works on what it reads, a few megabytes at a time. Only stretches that windows of words occurring twice in
    the row cover are searched; every such run lies in one of them. Of a text longer than a slice the words, not the bytes, are held as numbers.
    """
    if least_periods < 3 or least_words < 1:
        raise ValueError("at least 3 periods and 1 word")
    window = max(1, min(WINDOW, least_words - least_words // 3))
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _find(batches, least_words, least_periods, window, rearrange)

    got = map_batches(docs, [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")], work,
                      f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return got.withColumnRenamed("id", id_col)
