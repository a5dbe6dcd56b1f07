"""Words and word n-grams of Arrow text columns as 64-bit names, computed for whole slices at once with numpy.

A word is a run of bytes other than blank and 0x09-0x0D of the UTF-8 text, with A-Z lower-cased. Names are hashes that are equal on
every machine and in every run; equal strings have equal names, and different ones differ but for chance (2**-64 a pair).
A null text counts as empty; an empty text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a slice of its own. Memory is about 60 times this.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1: ASCII letters and digits, 2: other ASCII marks but the apostrophe, 4: the rest.
KIND = np.full(256, 4, np.uint8)
KIND[33:127] = 2
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
KIND[39] = 4
#: Letters, digits and all that isn't ASCII.
PLAIN = (KIND == 1) | (np.arange(256) >= 128)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 8 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


class Rolling:
    """Names of any substring of a byte array in constant time."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _power("up", len(data)), out=self.sums[1:])
        self.down = _power("down", len(data) + 1)

    def names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of successive rows whose texts have at most ``limit`` bytes together, or of one longer row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z, and of the capitals of Latin-1 in their two UTF-8 bytes."""
    low = _LOWER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[latin] += 32
    return low


def spans(inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` that begin anew at every place in ``cut`` (one longer than ``inside``)."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(names of all words, where each row's words begin, with the end last); ``plain`` takes ASCII marks for blanks too."""
    if lower:
        data = _LOWER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts, ends = spans(PLAIN[data] if plain else ~BLANK[data], cut)
    return Rolling(data).names(starts, ends), np.searchsorted(starts, offsets)


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words, cut also between an ASCII letter or digit and another ASCII mark that isn't an apostrophe."""
    cut = np.zeros(len(data) + 1, bool)
    kind = KIND[data]
    cut[1:-1] = kind[1:] + kind[:-1] == 3
    cut[offsets] = True
    return spans(~BLANK[data], cut)


def ngrams(names: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of ``n`` words within a row, in order, and their bounds."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], counts)
    got = np.full(len(at), n, np.uint64)
    for k in range(n):
        got = mix(got * np.uint64(0x9FB21C651E98DF25) + names[at + k]) if k else got + names[at]
    return mix(got), out


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingles(names: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each row, ascending within the row, and their bounds; a row of fewer words has them all as one."""
    got, at = ngrams(names, bounds, n)
    rows = row_of(at)
    for size in range(1, n):
        short = np.flatnonzero(np.diff(bounds) == size)
        if len(short):
            whole, _ = ngrams(names[(bounds[short][:, None] + np.arange(size)).ravel()], np.arange(len(short) + 1) * size, size)
            got, rows = np.concatenate([got, whole]), np.concatenate([rows, short])
    order = np.lexsort((got, rows))
    got, rows = got[order], rows[order]
    keep = np.ones(len(got), bool)
    keep[1:] = (got[1:] != got[:-1]) | (rows[1:] != rows[:-1])
    got, rows = got[keep], rows[keep]
    return got, np.searchsorted(rows, np.arange(len(bounds)))
