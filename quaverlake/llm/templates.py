"""Benchmark decontamination by templates: numbers, names and units become typed slots, windows of templates are joined by hash, and the values
in the slots must agree along an alignment.

A question that was copied with other numbers or names has the template of the original, and one value of the original became one other value
throughout. An alignment of a text with an item is a fixed shift between their token places. A word that opens a sentence may be a name, so windows
over such words are also read with all of them as names. Windows of the words as they stand go along, so a verbatim copy needs no slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm import words
from quaverlake.llm.tables import map_batches, sized, spare, table_bytes, written

#: Words that are units of measure.
UNITS = ("mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons tonnes ml l liter liters litre litres "
         "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degrees "
         "meter meters metre metres kilometer kilometers kilogram kilograms gram grams mph kmh watt watts volt volts hz khz mhz ghz kb mb gb tb").split()

#: Mark of windows of words as they stand.
EXACT = np.uint64(0xE8AC7)
NUMBER, NAME, UNIT = (words.mix(np.array([i], np.uint64))[0] for i in (0xA11CE, 0xB0B, 0xCAFE))

#: Window hashes of the benchmark that are sent to every task at most, in bytes of the written table; a larger benchmark is joined by a shuffle.
BENCHMARK_BYTES = 32 << 20


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template names, word names, whether a token is a slot, whether it opens a sentence as a name may, bounds of rows) of the tokens of all rows.

    A token is a run of letters, digits and bytes beyond ASCII; a point or comma between digits belongs to the number. Numbers hold a digit;
    names begin with one capital A-Z inside a sentence; units are words of a fixed list.
    """
    n = len(data)
    digit = (data >= 48) & (data <= 57)
    inside = words.PLAIN[data]
    if n > 2:
        inside[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts, ends = words.spans(inside, cut)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    folded = words.folded(data)
    names = words.Rolling(folded).names(starts, ends)
    digits = np.concatenate(([0], np.cumsum(digit)))
    number = digits[ends] > digits[starts]
    second = data[np.minimum(starts + 1, n - 1)]
    capital = (data[starts] >= 65) & (data[starts] <= 90) & (ends - starts > 1) & ((second >= 97) & (second <= 122) | (second >= 128))
    stop = np.isin(data, np.frombuffer(b".!?:;\n\r\"", np.uint8))
    stops = np.concatenate(([0], np.cumsum(stop)))
    before = np.concatenate(([0], ends[:-1]))
    bounds = np.searchsorted(starts, offsets)
    opening = stops[starts] > stops[before]
    opening[bounds[:-1][bounds[:-1] < len(starts)]] = True
    unit = np.isin(names, _unit_names())
    maybe = capital & ~number & ~unit
    name = maybe & ~opening
    out = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, names)))
    return out, names, number | unit | name, maybe & opening, bounds


def _unit_names() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return words.words(data, np.array([0, len(data)]))[0]


def _grams(names: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Names of the runs of ``size`` tokens from each of the given tokens on."""
    got = np.full(len(first), size, np.uint64)
    for k in range(size):
        got = words.mix(got * np.uint64(0x9FB21C651E98DF25) + names[first + k])
    return got


def _windows(tokens: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], size: int, plain: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, row, place in the row, first token, slots) of windows of ``size`` tokens of a ``template``, in batches: those with at least ``plain`` ordinary words,
    and with each word that opens a sentence as a name, where there is one. A negative size stands for windows of the words as they stand."""
    names, raw, slot, maybe, bounds = tokens
    length = abs(size)
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = place + bounds[rows]
    if size < 0:
        yield words.mix(_grams(raw, first, length) ^ EXACT), rows, place, first, np.zeros(len(raw), bool)
        return
    within = lambda x: (lambda sums: sums[first + length] - sums[first])(np.concatenate(([0], np.cumsum(x))))
    for reading, slots, keep in ((names, slot, True), (np.where(maybe, NAME, names), slot | maybe, within(maybe) > 0)):
        kept = keep & (length - within(slots) >= plain)
        yield _grams(reading, first[kept], length), rows[kept], place[kept], first[kept], slots


def _slot_values(first: np.ndarray, size: int, raw: np.ndarray, slot: np.ndarray) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """The word names in the slots of each window, in order; the window and the token of each."""
    places = np.flatnonzero(slot)
    low, high = np.searchsorted(places, first), np.searchsorted(places, first + size)
    bounds = np.concatenate(([0], np.cumsum(high - low)))
    at = np.arange(bounds[-1]) + np.repeat(low - bounds[:-1], high - low)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(raw[places[at]].astype(np.int64))), words.row_of(bounds), places[at]


def benchmark_windows(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", size: int = 8, plain: int = 4, tokens: int = 13) -> DataFrame:
    """(window, size, item, place, values, spots, windows) of every item: what ``_windows`` gives for its windows of ``size`` tokens or, of fewer tokens, for all of it.

    Windows of ``tokens`` tokens, or of all of an item that has fewer, are there too: they have enough ordinary words where the shorter ones have not.
    ``spots`` are the item's tokens that the values stand at. An exact window has a negative size and no values.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, offsets in words.text_slices(batch.column(1)):
                read = template(data, offsets)
                raw, bounds = read[1], read[4]
                lengths = np.diff(bounds)
                for k in [*range(-size, 0), *range(plain, max(size, tokens) + 1)]:
                    for got, rows, place, first, slot in _windows(read, k, plain):
                        own = (lengths[rows] == abs(k)) | (abs(k) == size) | (k == tokens)
                        got, rows, place, first = got[own], rows[own], place[own], first[own]
                        if len(got):
                            values, of, spots = _slot_values(first, abs(k), raw, slot)
                            spots = pa.ListArray.from_arrays(values.offsets, pa.array(spots - bounds[rows[of]]))
                            yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int64)), pa.array(np.full(len(got), k, np.int32)), batch.column(0).take(pa.array(begin + rows)),
                                                              pa.array(place), values, spots, pa.array(np.maximum(1, lengths[rows] - size + 1))],
                                                             ["window", "size", "item", "place", "values", "spots", "windows"])

    kind = benchmark.schema[item_col].dataType.simpleString()
    columns = [F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")]
    return written(map_batches(benchmark, columns, work, f"window long, size int, item {kind}, place long, values array<long>, spots array<long>, windows long"))


def _text_windows(texts: DataFrame, sizes: list[int], plain: int, wanted: np.ndarray | None) -> DataFrame:
    """(node, window, place, values) of texts, only the wanted windows where they are given."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            fresh = np.array([x not in seen and not seen.add(x) for x in nodes.tolist()], bool)
            column, nodes = batch.column(1).filter(pa.array(fresh)), nodes[fresh]
            for begin, data, offsets in words.text_slices(column):
                read = template(data, offsets)
                for got, rows, place, first, slot, size in ((*x, size) for size in sizes for x in _windows(read, size, plain)):
                    if wanted is not None and len(wanted):
                        got_ = got.astype(np.int64)
                        hit = wanted[np.minimum(np.searchsorted(wanted, got_), len(wanted) - 1)] == got_
                        got, rows, place, first = got[hit], rows[hit], place[hit], first[hit]
                    if len(got):
                        yield pa.RecordBatch.from_arrays([pa.array(nodes[begin + rows]), pa.array(got.astype(np.int64)), pa.array(place), _slot_values(first, abs(size), read[1], slot)[0]],
                                                         ["node", "window", "place", "values"])

    return map_batches(texts, ["node", "text"], work, "node long, window long, place long, values array<long>")


def leaked_items(texts: DataFrame, windows: DataFrame, *, size: int = 8, plain: int = 4, tokens: int = 13) -> DataFrame:
    """(node, item, shift, place, n_windows, n_slots, n_changed): alignments of texts (node, text) with items that share enough of a template.

    Enough: the windows of ``tokens`` successive tokens, or all of an item that has fewer, or one window of that many. Along an alignment one value of
    the item must stand for one value of the text, that at most of its places: windows with another value count for nothing, nor do those with a value
    that has no such one. Exact windows always count.
    """
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most tokens + size numbers
    wanted = None
    if table_bytes(windows) <= BENCHMARK_BYTES:
        wanted = np.array(sorted({r[0] for r in windows.select("window").distinct().collect()}), np.int64)
    hits = _text_windows(texts, sizes or [size], plain, wanted)
    hits = hits if wanted is not None and len(wanted) else hits.where("true" if sizes else "false")
    # the item within a struct: a null one is joined like any other
    matched = written(hits.join(windows.withColumnsRenamed({"place": "item_place", "values": "item_values"}), "window")
                      .withColumn("shift", F.col("place") - F.col("item_place")).withColumn("item", F.struct("item")))
    key = ["node", "item", "shift"]
    here = [*key, "window", "item_place"]
    values = matched.select(*here, F.explode(F.arrays_zip("spots", "item_values", "values")).alias("p")).select(*here, "p.spots", F.col("p.item_values").alias("x"), F.col("p.values").alias("y"))
    pairs = values.groupBy(*key, "x", "y").agg(F.countDistinct("spots").alias("c"))
    torn = pairs.groupBy(*key, "x").agg(F.sum("c").alias("all"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    odd = pairs.join(torn, [*key, "x"]).where("2 * c <= all").select(*key, "x", "y")
    fine = matched.join(values.join(odd, [*key, "x", "y"], "left_semi").select(*here).distinct(), here, "left_anti")
    slots = pairs.groupBy(*key).agg(F.countDistinct("x", "y").alias("n_slots"), F.sum((F.col("x") != F.col("y")).cast("long")).alias("n_changed"))
    long_enough = (fine.groupBy(*key).agg(F.min("place").alias("place"), F.countDistinct("item_place").alias("n_windows"), F.max("windows").alias("windows"), F.max("size").alias("longest"))
                   .where((F.col("longest") > size) | (F.col("n_windows") >= F.least(F.col("windows"), F.lit(max(1, tokens - size + 1))))).drop("windows", "longest"))
    return long_enough.join(slots, key, "left").fillna(0, ["n_slots", "n_changed"]).withColumn("item", F.col("item.item"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 8,
                 plain: int = 4, tokens: int = 13) -> DataFrame:
    """(id, item, n_windows, n_slots, n_changed, place): each row and item of which it holds a copy or a copy with other values, its best alignment.

    ``place`` is the token of the text where the alignment first matches. Equal texts give equal rows, each under its own id; null ids and
    null items are carried; null and empty texts hold nothing, an item of fewer than ``plain`` ordinary words is found as it stands only, one without tokens in nothing; equal items are
    each reported; other columns aren't read; empty tables give no rows.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("node", F.xxhash64("text"))
    found = leaked_items(named.where("text IS NOT NULL").select("node", "text"), benchmark_windows(benchmark, item_col=item_col, text_col=item_text_col, size=size, plain=plain, tokens=tokens),
                         size=size, plain=plain, tokens=tokens)
    best = written(found.groupBy("node", "item").agg(F.max(F.struct("n_windows", "n_slots", F.negative("n_changed").alias("same"), F.negative("place").alias("at"))).alias("b")))
    return named.where("text IS NOT NULL").select("id", "node").join(best, "node").select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.n_windows").alias("n_windows"), F.col("b.n_slots").alias("n_slots"),
        F.negative("b.same").alias("n_changed"), F.negative("b.at").alias("place"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how: object) -> DataFrame:
    """The rows that hold no item, all columns as they were; rows of null text stay."""
    node, text = spare(docs, "__node"), F.col(f"`{text_col}`").cast("string")
    found = leaked_items(docs.where(text.isNotNull()).select(F.xxhash64(text).alias("node"), text.alias("text")), benchmark_windows(benchmark, **how), **how)
    bad = written(found.select(F.col("node").alias(node)).distinct())
    return docs.withColumn(node, F.xxhash64(text)).join(sized(bad), node, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
