"""An n-gram language model as a trie of three Elias-Fano levels in memory-mapped files.

Words are numbered by the order of their hashes. A pair (u, v) is the number ``u V + v``; a triple (u, v, w) is ``i M + r``, where i is the place of
the pair (u, v) and r the place of w among the successors of v: the successor search is relative to the shorter context. Each level holds its
sorted numbers, cumulated counts and pointers to first successors as monotone sequences, and quantised probabilities and back-off factors.

Probabilities are interpolated with absolute discounts: a pair has ``(c - D) / c(u) + b(u) P(v)``, a triple the like over pairs. Words have
``(c + 0.1) / (N + 0.1 (V + 1))``. The probabilities of a context add up to one but for the quantisation (a 4096th of a decade).

The files lie in the shared folder in shards of bounded size, each written by one task; scoring tasks map them and touch what they look up.
A level costs one shuffle. Its numbers go to shards by where their occurrences would lie if they were sorted: the cumulated count of the context,
plus the successor's share of it. That grows with the number, so shards follow each other, and a frequent context takes as many as it needs. What
a task has counted crosses the shuffle as packed blocks. Pointers, back-off factors and probabilities are then looked up in the mapped files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm import words
from quaverlake.llm.elias import Monotone, map_arrays, write_arrays
from quaverlake.llm.tables import map_batches, shared_path, written
from quaverlake.session import ship_package

#: Words of a file, and occurrences behind a file of pairs or triples, about.
SHARD = 1 << 20
#: Tokens that are looked up together, about: a file is opened for all of them at once, however many files there are.
POOL = 1 << 19
#: Steps of a decade in a quantised logarithm.
STEPS = 4096
END = words.mix(np.array([0xE0D], np.uint64))[0]


@dataclass(frozen=True)
class Level:
    """The common name of a level's files; ``index`` there holds the first number, place and cumulated count of each, and its own name."""

    path: str


@dataclass(frozen=True)
class Model:
    """``tokens`` and ``types`` of the training rows, the three levels, the largest number of successors, the discount."""

    tokens: int
    types: int
    fan: int
    discount: float
    words: Level
    pairs: Level | None = None
    triples: Level | None = None


_mapped: dict[str, dict[str, np.ndarray]] = {}


def _file(path: str) -> dict[str, np.ndarray]:
    if path not in _mapped:
        if len(_mapped) > 4096:
            _mapped.clear()
        _mapped[path] = map_arrays(path)
    return _mapped[path]


class Reader:
    """Look-ups in a level for many numbers or places at once."""

    def __init__(self, level: Level):
        self.level = level
        index = _file(f"{level.path}/index")
        self.firsts, self.places, self.sums, self.names = (index[k] for k in ("firsts", "places", "sums", "names"))
        self.entries = int(index["entries"][0])
        self.open: dict[tuple[str, int, str], Monotone] = {}

    def _arrays(self, kind: str, shard: int) -> dict[str, np.ndarray]:
        return _file(f"{self.level.path}/{kind}-{self.names[shard]}")

    def _part(self, kind: str, shard: int, name: str) -> Monotone:
        key = (kind, shard, name)
        if key not in self.open:
            self.open[key] = Monotone.mapped(self._arrays(kind, shard), name)
        return self.open[key]

    def _by_shard(self, starts: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
        """(shard, which of ``keys``), without those before the first shard."""
        if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
            shard = np.searchsorted(starts, keys, "right") - 1
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            for group in np.split(order, cuts):
                if len(group) and shard[group[0]] >= 0:
                    yield int(shard[group[0]]), group
            return
        cuts = np.append(np.searchsorted(keys, starts), len(keys))  # ascending keys: each shard has one stretch of them
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            yield s, slice(cuts[s], cuts[s + 1])

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each number, or -1."""
        out = np.full(len(numbers), -1, np.int64)
        for s, at in self._by_shard(self.firsts, numbers):
            got = self._part("entries", s, "numbers").find(numbers[at] - self.firsts[s])
            out[at] = np.where(got < 0, -1, got + self.places[s])
        return out

    def lower(self, numbers: np.ndarray) -> np.ndarray:
        """The first place whose number is not below each."""
        out = np.zeros(len(numbers), np.int64)
        for s, at in self._by_shard(self.firsts, numbers):
            out[at] = self._part("entries", s, "numbers").lower(numbers[at] - self.firsts[s]) + self.places[s]
        return out

    def numbers(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        for s, at in self._by_shard(self.places, places):
            out[at] = self._part("entries", s, "numbers").get(places[at] - self.places[s]) + self.firsts[s]
        return out

    def before(self, places: np.ndarray) -> np.ndarray:
        """Counts of all entries before each place, which may be the level's end."""
        out = np.zeros(len(places), np.int64)
        for s, at in self._by_shard(self.places, places):
            out[at] = self._part("entries", s, "sums").get(places[at] - self.places[s]) + self.sums[s]
        return out

    def counts(self, places: np.ndarray) -> np.ndarray:
        """Counts; 0 for the place -1."""
        out = np.zeros(len(places), np.int64)
        for s, at in self._by_shard(self.places, places):
            out[at] = self._part("entries", s, "sums").steps(places[at] - self.places[s])[1]
        return out

    def spans(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(``before``, ``counts``) of places of entries."""
        before, counts = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for s, at in self._by_shard(self.places, places):
            before[at], counts[at] = self._part("entries", s, "sums").steps(places[at] - self.places[s])
            before[at] += self.sums[s]
        return before, counts

    def starts(self, places: np.ndarray) -> np.ndarray:
        """The place, in the next level, of the first successor."""
        out = np.zeros(len(places), np.int64)
        for s, at in self._by_shard(self.places, places):
            out[at] = self._part("contexts", s, "starts").get(places[at] - self.places[s]) + self._arrays("contexts", s)["origin"][0]
        return out

    def followers(self, places: np.ndarray) -> np.ndarray:
        """How many successors there are."""
        out = np.zeros(len(places), np.int64)
        for s, at in self._by_shard(self.places, places):
            out[at] = self._part("contexts", s, "starts").steps(places[at] - self.places[s])[1]
        return out

    def logs(self, kind: str, places: np.ndarray) -> np.ndarray:
        """Quantised log10 of ``probs`` (probabilities) or ``contexts`` (back-off factors); 0 for the place -1."""
        out = np.zeros(len(places))
        for s, at in self._by_shard(self.places, places):
            out[at] = self._arrays(kind, s)["codes"][places[at] - self.places[s]] / -STEPS
        return out

    def shard(self, s: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(first place, numbers, counts) of a whole shard."""
        numbers, sums = self._part("entries", s, "numbers"), self._part("entries", s, "sums")
        i = np.arange(numbers.n + 1)
        return int(self.places[s]), numbers.get(i[:-1]) + self.firsts[s], np.diff(sums.get(i))


def _codes(p: np.ndarray) -> np.ndarray:
    return np.minimum(65535, np.rint(-np.log10(np.maximum(p, 1e-15)) * STEPS)).astype(np.uint16)


class Readers:
    """The levels of a model, opened as they are used."""

    def __init__(self, model: Model):
        self.model = model
        self.words, self.pairs, self.triples = (Reader(x) if x is not None else None for x in (model.words, model.pairs, model.triples))

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.model.tokens + 0.1 * (self.model.types + 1))

    def ids(self, names: np.ndarray) -> np.ndarray:
        unique, where = np.unique(names, return_inverse=True)
        return self.words.find(unique)[where]

    def pair_finds(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the places of distinct pairs, ascending but for -1; which of them ends with each token, or -1); ``first`` marks first tokens of rows."""
        ok = np.zeros(len(ids), bool)
        ok[1:] = (ids[1:] >= 0) & (ids[:-1] >= 0) & ~first[1:]
        at = np.flatnonzero(ok)
        unique, where = np.unique(ids[at - 1] * self.model.types + ids[at], return_inverse=True)
        out = np.full(len(ids), -1, np.int64)
        out[at] = where
        return self.pairs.find(unique), out

    def pair_places(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each token, the place of the pair that ends with it, or -1; ``first`` marks first tokens of rows."""
        found, which = self.pair_finds(ids, first)
        return np.append(found, -1)[which]

    def triple_numbers(self, ids: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, numbers) of the triples whose two pairs have entries."""
        ok = np.zeros(len(ids), bool)
        ok[1:] = (pairs[1:] >= 0) & (pairs[:-1] >= 0) & ~first[1:]
        at = np.flatnonzero(ok)
        middle, where = np.unique(ids[at - 1], return_inverse=True)
        return at, pairs[at - 1] * self.model.fan + pairs[at] - self.words.starts(middle)[where]


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word names in 63 bits, bounds) by slices; each row ends with the end token."""
    for begin, data, offsets in words.text_slices(column):
        names, bounds = words.words(data, offsets)
        rows = len(bounds) - 1
        out = np.full(len(names) + rows, END, np.uint64)
        ends = bounds[1:] + np.arange(rows)
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = names
        yield begin, (out >> np.uint64(1)).astype(np.int64), np.concatenate(([0], ends + 1))


def _pools(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """(the rows, word names, bounds) of successive slices of ``_tokens`` with about ``POOL`` tokens together, across batches."""
    rows, held, lengths, size = [], [], [], 0
    for batch in batches:
        for begin, names, bounds in _tokens(batch.column(column)):
            rows.append(batch.select([i for i in range(batch.num_columns) if i != column]).slice(begin, len(bounds) - 1))
            held.append(names)
            lengths.append(np.diff(bounds))
            size += len(names)
            if size >= POOL:
                yield rows, np.concatenate(held), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
                rows, held, lengths, size = [], [], [], 0
    if rows:
        yield rows, np.concatenate(held), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))


def _first(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    first = np.zeros(len(names), bool)
    first[bounds[:-1]] = True
    return first


def _added(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number once, ascending, with the sum of its counts."""
    order = np.argsort(numbers, kind="stable")
    numbers, counts = numbers[order], counts[order]
    begin = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1])))
    return numbers[begin], np.add.reduceat(counts, begin)


class _Counter:
    """Counts of numbers within bounded memory; what does not fit goes on early, to be added up after the shuffle."""

    def __init__(self, room: int = 3_000_000):
        self.room, self.held, self.size = room, [], 0

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        return _added(np.concatenate([h[0] for h in self.held]), np.concatenate([h[1] for h in self.held]))

    def add(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(numbers):
            unique, counts = np.unique(numbers, return_counts=True)
            self.held.append((unique, counts))
            self.size += len(unique)
            if self.size > self.room:
                self.held = [self._merged()]
                self.size = len(self.held[0][0])
                if self.size > self.room // 2:
                    yield from self.flush()

    def flush(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            merged = self._merged()
            self.held, self.size = [], 0
            yield merged


def _block(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending numbers as differences, and their counts, by planes of bytes, compressed."""
    planes = np.stack([np.diff(numbers, prepend=0), counts]).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unblock(block: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(block, 16 * n, "zstd", asbytes=True), np.uint8).reshape(8, 2 * n)
    values = np.ascontiguousarray(planes.T).view("<i8").ravel()
    return np.cumsum(values[:n]), values[n:]


def _entries(numbers: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    return Monotone.of(numbers - numbers[0]).arrays("numbers") | Monotone.of(np.concatenate(([0], np.cumsum(counts)))).arrays("sums")


def _index(done: list, path: str) -> Level:
    """Writes the index of a level from (name, first number, entries, count) of its files; one row for each file."""
    rows = np.array(sorted(tuple(r) for r in done if r[2]), np.int64).reshape(-1, 4)
    before = np.cumsum(np.concatenate((np.zeros((1, 2), np.int64), rows[:, 2:])), axis=0)[:-1]
    write_arrays(f"{path}/index", {"names": rows[:, 0], "firsts": rows[:, 1], "places": before[:, 0], "sums": before[:, 1],
                                     "entries": rows[:, 2].sum(keepdims=True)})
    return Level(path)


_FILE = "name long, first long, n long, c long"


def _file_row(path: str, name: int, numbers: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Writes the entries of a file; its row for the index."""
    if len(numbers):
        write_arrays(f"{path}/entries-{name}", _entries(numbers, counts))
    row = [name, int(numbers[0]) if len(numbers) else 0, len(numbers), int(counts.sum())]
    return pa.table({k: [v] for k, v in zip(("name", "first", "n", "c"), row)}, schema=pa.schema([(k, pa.int64()) for k in ("name", "first", "n", "c")]))


def _word_level(texts: DataFrame, path: str, size: int) -> tuple[Level, int, int]:
    """(the level, tokens, types): words in the order of their hashes, about ``size`` in a file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(numbers: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(numbers), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[i:i + 500_000]), pa.array(counts[i:i + 500_000])], ["number", "c"])

        counter = _Counter()
        for batch in batches:
            for _, names, _ in _tokens(batch.column(0)):
                for merged in counter.add(names):
                    yield from rows(*merged)
        for merged in counter.flush():
            yield from rows(*merged)

    def write(held: pa.Table) -> pa.Table:
        return _file_row(path, held.column("shard")[0].as_py(), *_added(held.column("number").to_numpy(), held.column("c").to_numpy()))

    counted = written(map_batches(texts, ["text"], count, "number long, c long").groupBy("number").agg(F.sum("c").alias("c")))
    tokens, types = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Hashes are spread evenly, so equal stretches of them hold about as many words.
    width = -(-(1 << 63) // max(1, -(-types // size)))
    done = counted.withColumn("shard", F.expr(f"number div {width}L") if width < 1 << 63 else F.lit(0).cast("long")).groupBy("shard").applyInArrow(write, _FILE).collect()
    return _index(done, path), int(tokens), int(types)


def _level(texts: DataFrame, counting, least: int, path: str, size: int) -> Level:
    """The level of all numbers that occur ``least`` times. ``counting()`` gives two functions: the numbers in (word names, bounds), and the
    occurrences that lie before ascending numbers, about, in ascending order; ``size`` of these make a file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, (find, position) = _Counter(), counting()

        def blocks(numbers: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            names = position(numbers) // size
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(names)) + 1, [len(names)]))
            for g in range(0, len(cuts) - 1, 256):
                ends = cuts[g:g + 257]
                held = [_block(numbers[i:j], counts[i:j]) for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(names[ends[:-1]]), pa.array(np.diff(ends)), pa.array(held, pa.binary())], ["name", "n", "block"])

        for _, names, bounds in _pools(batches, 0):
            for merged in counter.add(find(names, bounds)):
                yield from blocks(*merged)
        for merged in counter.flush():
            yield from blocks(*merged)

    def write(held: pa.Table) -> pa.Table:
        parts = [_unblock(b.as_py(), n.as_py()) for b, n in zip(held.column("block"), held.column("n"))]
        numbers, counts = _added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return _file_row(path, held.column("name")[0].as_py(), numbers[counts >= least], counts[counts >= least])

    return _index(map_batches(texts, ["text"], count, "name long, n long, block binary").groupBy("name").applyInArrow(write, _FILE).collect(), path)


def _each_shard(spark: SparkSession, level: Level, work) -> int:
    """``work(shard)`` for each file of a level, in tasks; the largest number returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([work(s) for s in batch.column(0).to_pylist()], pa.int64())], ["got"])

    files = len(Reader(level).names)
    ship_package(spark)
    return int(spark.range(0, files, 1, max(1, min(files, 4096))).mapInArrow(run, "got long").agg(F.max("got")).first()[0] or 0)


def _contexts(spark: SparkSession, level: Level, longer: Level, fan: int, discount: float) -> int:
    """Writes pointers to first successors and back-off factors of the entries of ``level``, whose successors in ``longer`` have the numbers
    from ``place * fan`` on; the largest number of successors."""

    def work(s: int) -> int:
        at, after = Reader(level), Reader(longer)
        first, _, counts = at.shard(s)
        starts = after.lower(np.arange(first, first + len(counts) + 1) * fan)
        n = np.diff(starts)
        kept = np.diff(after.before(starts)) - discount * n
        write_arrays(f"{level.path}/contexts-{at.names[s]}", Monotone.of(starts - starts[0]).arrays("starts")
                     | {"origin": starts[:1], "codes": _codes(1.0 - kept / counts)})
        return int(n.max())

    return _each_shard(spark, level, work)


def _probabilities(spark: SparkSession, level: Level, of) -> None:
    """Writes ``of()(numbers, counts)``, quantised, for the entries of ``level``."""

    def work(s: int) -> int:
        at = Reader(level)
        _, numbers, counts = at.shard(s)
        write_arrays(f"{level.path}/probs-{at.names[s]}", {"codes": _codes(of()(numbers, counts))})
        return 0

    _each_shard(spark, level, work)


def train(texts: DataFrame, *, discount: float = 0.75, least: int = 1, size: int = SHARD) -> Model:
    """Fits the model to all rows of ``texts`` (text; null counts as empty). Pairs and triples have entries from ``least`` occurrences on; the
    share of others is in the back-off factors. ``size`` is that of the files.

    A triple that occurs so often has two pairs that do, so only such triples are counted. An empty table gives a model without words.
    """
    spark, path = texts.sparkSession, shared_path(texts.sparkSession)
    word_level, tokens, types = _word_level(texts, f"{path}/words", size)
    if types >= 1 << 31:
        raise ValueError("a pair of words must fit in 62 bits")
    model = Model(tokens, types, 1, discount, word_level)

    def spread(at: Reader, contexts: np.ndarray, share) -> np.ndarray:
        begin = np.flatnonzero(np.diff(contexts, prepend=-1))  # contexts ascend
        unique, where = contexts[begin], np.repeat(np.arange(len(begin)), np.diff(begin, append=len(contexts)))
        before, counts = (x[where] for x in at.spans(unique))
        return before + np.minimum(counts - 1, (counts * share(unique, where)).astype(np.int64))

    def pair_counting():
        at = Readers(model)

        def find(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            ids = at.ids(names)
            later = np.flatnonzero(~_first(names, bounds))
            return ids[later - 1] * types + ids[later]

        return find, lambda numbers: spread(at.words, numbers // types, lambda unique, where: numbers % types / types)

    pair_level = _level(texts, pair_counting, least, f"{path}/pairs", size)
    fan = max(1, _contexts(spark, word_level, pair_level, types, discount))
    if Reader(pair_level).entries * fan >= 1 << 62:
        raise ValueError("a triple of words must fit in 62 bits")

    def pair_probabilities():
        at = Readers(model)

        def of(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
            context, after = numbers // types, numbers % types
            return (counts - discount) / at.words.counts(context) + 10.0 ** at.words.logs("contexts", context) * at.p1(at.words.counts(after))

        return of

    _probabilities(spark, pair_level, pair_probabilities)
    model = Model(tokens, types, fan, discount, word_level, pair_level)

    def triple_counting():
        at = Readers(model)

        def find(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            ids, first = at.ids(names), _first(names, bounds)
            return at.triple_numbers(ids, at.pair_places(ids, first), first)[1]

        def share(numbers: np.ndarray, unique: np.ndarray, where: np.ndarray) -> np.ndarray:
            return numbers % fan / np.maximum(1, at.words.followers(at.pairs.numbers(unique) % types))[where]

        return find, lambda numbers: spread(at.pairs, numbers // fan, lambda unique, where: share(numbers, unique, where))

    triple_level = _level(texts, triple_counting, least, f"{path}/triples", size)
    _contexts(spark, pair_level, triple_level, fan, discount)

    def triple_probabilities():
        at = Readers(model)

        def of(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
            context, rest = numbers // fan, numbers % fan
            shorter = at.words.starts(at.pairs.numbers(context) % types) + rest
            return (counts - discount) / at.pairs.counts(context) + 10.0 ** (at.pairs.logs("contexts", context) + at.pairs.logs("probs", shorter))

        return of

    _probabilities(spark, triple_level, triple_probabilities)
    return Model(tokens, types, fan, discount, word_level, pair_level, triple_level)


def _each_log(level: Reader, kind: str, found: np.ndarray) -> np.ndarray:
    """The logarithms of places that ascend but for -1, which has 0, and a 0 behind them all, for the index -1."""
    out = np.zeros(len(found) + 1)
    hit = np.flatnonzero(found >= 0)
    out[hit] = level.logs(kind, found[hit])
    return out


def text_scores(at: Readers, names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base score, score) of each row."""
    rows = len(bounds) - 1
    unique, where = np.unique(names, return_inverse=True)
    places = at.words.find(unique)
    counts = at.words.counts(places)
    base = np.log10(at.p1(counts))[where]
    ids, known, first = places[where], (counts > 0)[where], _first(names, bounds)
    found, which = at.pair_finds(ids, first)
    pairs = np.append(found, -1)[which]
    tokens, numbers = at.triple_numbers(ids, pairs, first)
    unique, back = np.unique(numbers, return_inverse=True)
    triples = at.triples.find(unique)
    three = np.zeros(len(names), bool)
    three[tokens] = (triples >= 0)[back]
    two = ~three & (pairs >= 0)
    one = ~three & ~two
    before = np.concatenate(([-1], np.where(first[1:], -1, which[:-1])))  # the pair that is the context
    word_before = np.concatenate(([-1], np.where(first[1:], -1, ids[:-1])))
    score = np.zeros(len(names))
    score[tokens] = _each_log(at.triples, "probs", triples)[back]
    score[two] = _each_log(at.pairs, "probs", found)[which[two]]
    score[one] = base[one] + at.words.logs("contexts", word_before[one])
    score[~three] += _each_log(at.pairs, "contexts", found)[before[~three]]
    row = words.row_of(bounds)
    return tuple(np.bincount(row, x, minlength=rows) for x in (known, base, score))


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; a null text counts as empty: its end token alone.

    Repeated rows are scored alike, null ids carried, other columns not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Readers(model)
        for rows, names, bounds in _pools(batches, 1):
            known, base, score = text_scores(at, names, bounds)
            ids, n = pa.concat_arrays([r.column(0) for r in rows]), len(bounds) - 1
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), pa.array(known.astype(np.int64)), pa.array(np.full(n, model.tokens)), pa.array(base), pa.array(score)],
                                             ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    columns = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    return map_batches(docs, columns, work, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def held_out_scores(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", least: int = 1, size: int = SHARD) -> DataFrame:
    """``scored`` with the column ``held_out``: rows for which it holds, or is null, teach the model nothing. ``least`` and ``size`` are those of ``train``."""
    marked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    model = train(marked.where("NOT held_out").select("text"), least=least, size=size)
    got = scored(marked, model, id_col=id_col)
    return got.withColumn("held_out", F.coalesce(held_out, F.lit(True)))
