"""Monotone integer sequences in Elias-Fano form, as flat arrays that can be mapped from a file, with all look-ups for many places at once."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_ONE, _63 = np.uint64(1), np.uint64(63)
_55, _33, _0F, _01, _80 = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
_1, _2, _4, _8, _56, _255 = (np.uint64(x) for x in (1, 2, 4, 8, 56, 255))
#: Place of the r-th set bit of a byte, at 8 * byte + r.
_PLACES = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the ``rank``-th set bit of each word, from 0."""
    rank = rank.astype(np.uint64)
    sums = word - ((word >> _1) & _55)
    sums = (sums & _33) + ((sums >> _2) & _33)
    sums = ((sums + (sums >> _4)) & _0F) * _01  # byte i: the set bits of the bytes up to it
    shift = np.bitwise_count(((rank * _01 | _80) - sums) & _80).astype(np.uint64) * _8  # bytes before the one with the bit
    left = rank - (((sums << _8) >> shift) & _255)
    return shift.astype(np.int64) + _PLACES[(((word >> shift) & _255) << np.uint64(3) | left).astype(np.int64)]


class Monotone:
    """``arrays``: low bits, high bits in unary, and zeros before each word of these; ``n`` numbers of ``width`` low bits."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros
        self._ones: np.ndarray | None = None
        self._bytes: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> Monotone:
        """The form of non-negative numbers in ascending order, equal ones allowed."""
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, int(np.floor(np.log2(top / n)))) if n and top > n else 0
        upper = (values >> width).astype(np.int64)
        size = n + (int(upper[-1]) if n else 0) + 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[upper + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))))[:-1]
        flags = np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width].ravel()
        flags = np.concatenate([flags, np.zeros(128 - len(flags) % 64, np.uint8)])
        return cls(n, width, np.packbits(flags, bitorder="little").view(np.uint64), high, zeros)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i * self.width
        if self.width <= 57:  # eight bytes from the one with the first bit hold them all
            if self._bytes is None:
                self._bytes = np.ndarray((self.low.nbytes - 7,), "<u8", self.low, 0, (1,))
            low = self._bytes[bit >> 3]
            low >>= (bit & 7).view(np.uint64)
        else:
            word, shift = bit >> 6, (bit & 63).view(np.uint64)
            low = (self.low[word] >> shift) | ((self.low[word + 1] << (_63 - shift)) << _ONE)
        low &= np.uint64((1 << self.width) - 1)
        return low.view(np.int64)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _select(~self.high[word], k - self.zeros[word])

    def _place(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th one of the high bits."""
        if self._ones is None:
            self._ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(self._ones, i, "right") - 1
        return word * 64 + _select(self.high[word], i - self._ones[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places ``i``."""
        return (self._place(i) - i) << self.width | self._low(i)

    def steps(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers at the places ``i``, how much greater the next ones are)."""
        place = self._place(i)
        bits = (self.high[place >> 6] >> (place & 63).astype(np.uint64)) >> _ONE  # those behind the one, in its word
        after = place + 1 + np.bitwise_count(~bits & (bits - _ONE))
        far = np.flatnonzero(bits == 0)
        after[far] = self._place(i[far] + 1)
        now = (place - i) << self.width | self._low(i)
        return now, ((after - i - 1) << self.width | self._low(i + 1)) - now

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which numbers lie below the top, first place not below each in its bucket of high bits, end of the bucket, low bits of each)."""
        upper = x >> self.width
        last = len(self.high) * 64 - self.n - 1  # zeros there are at least
        inside = np.flatnonzero((x >= 0) & (upper <= min(last, self._top())))
        upper, rest = upper[inside], x[inside] & ((1 << self.width) - 1)
        begin = np.where(upper > 0, self._zero(np.maximum(upper - 1, 0)) + 1, 0) - upper
        end = self._zero(upper) - upper
        low, high = begin.copy(), end.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return inside, low, end, rest
            middle = (low[open_] + high[open_]) >> 1
            less = self._low(middle) < rest[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)

    def _ones_from(self, place: np.ndarray) -> np.ndarray:
        """How many set high bits follow each other from each place on; 64 stands for 64 or more."""
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        more = self.high[np.minimum(word + 1, len(self.high) - 1)]
        bits = (self.high[word] >> shift) | ((more << (_63 - shift)) << _ONE)
        return np.bitwise_count(bits & ~(bits + _ONE)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The first place of each number, or -1."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        upper = x >> self.width
        inside = np.flatnonzero((x >= 0) & (upper <= self._top()))
        upper, rest = upper[inside], x[inside] & ((1 << self.width) - 1)
        place = np.where(upper > 0, self._zero(np.maximum(upper - 1, 0)) + 1, 0)
        size = self._ones_from(place)
        long = np.flatnonzero(size == 64)
        if len(long):
            size[long] = self._zero(upper[long]) - place[long]
        held = np.flatnonzero(size)  # buckets of high bits that hold numbers
        inside, rest, size, at = inside[held], rest[held], size[held], (place - upper)[held]
        open_ = np.flatnonzero(size > 1)
        begin, left, want = at[open_], size[open_], rest[open_]
        while len(open_):
            half = left >> 1  # 0 where one is left, which then stays
            beyond = self._low(begin + (half - 1)) < want
            begin += half * beyond
            left = np.where(beyond, left - half, np.maximum(half, 1))
            more = left > 1
            if 2 * np.count_nonzero(more) < len(more):
                at[open_] = begin
                open_, begin, left, want = open_[more], begin[more], left[more], want[more]
        hit = np.flatnonzero(self._low(at) == rest)
        out[inside[hit]] = at[hit]
        return out

    def lower(self, x: np.ndarray) -> np.ndarray:
        """The first place whose number is not below each of ``x``; ``n`` where all are."""
        out = np.where(x < 0, 0, self.n)
        if self.n:
            inside, low, _, _ = self._search(x)
            out[inside] = low
        return out

    def _top(self) -> int:
        return int(self.get(np.array([self.n - 1]))[0] >> self.width)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.shape": np.array([self.n, self.width], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @classmethod
    def mapped(cls, held: dict[str, np.ndarray], name: str) -> Monotone:
        n, width = (int(v) for v in held[f"{name}.shape"])
        return cls(n, width, held[f"{name}.low"], held[f"{name}.high"], held[f"{name}.zeros"])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays; it gets its name when it is whole, so a task that is run again or twice does no harm."""
    store, name = _store(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    places, at = {}, 0
    for key, value in arrays.items():
        places[key] = (str(value.dtype), len(value), at)
        at += -(-value.nbytes // 64) * 64
    head = json.dumps(places).encode()
    draft = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        out.write(b"\0" * (-(8 + len(head)) % 64))
        for value in arrays.values():
            raw = np.ascontiguousarray(value).tobytes()
            out.write(raw + b"\0" * (-len(raw) % 64))
    store.move(draft, name)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; a file in a store without local paths is copied to an unnamed local file first."""
    store, name = _store(path)
    if isinstance(store, fs.LocalFileSystem):
        raw = np.memmap(name, np.uint8, "r")
    else:
        copy = tempfile.TemporaryFile()  # has no name, and goes with its mapping
        with store.open_input_stream(name) as source:
            while part := source.read(1 << 22):
                copy.write(part)
        copy.flush()
        raw = np.memmap(copy, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    start = -(-(8 + size) // 64) * 64
    places = json.loads(raw[8:8 + size].tobytes())
    return {key: np.frombuffer(raw, kind, n, start + at) if n else np.zeros(0, kind) for key, (kind, n, at) in places.items()}
