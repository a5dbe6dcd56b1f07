"""Bytes covered by strings of a given length that start in two places or more: prefix doubling on a sparse set of positions.

Plain prefix doubling ranks every byte position by its first h bytes and sorts pairs of ranks until positions are unique or h is long enough.
Here a rank is the 64-bit name of the bytes themselves, so pairs need no look-up of other rows, and positions are first ranked in sets:

* Each window of ``length`` bytes chooses one of its ``anchor``-byte strings, the one of least hash. Equal windows choose equal strings at
  equal offsets. The windows of a text that choose the same place form a run; the first sort ranks runs by their anchor.
* A set of windows has a core, the bytes common to all of them, and a hull, the bytes that any of them has. Unique core: no window of the
  set occurs elsewhere, and the set drops out. Hull found twice: all its windows are repeats, and the set is done. Otherwise it is cut into
  smaller sets, whose cores are longer (40, 169, 193, then 200 bytes), and ranked again.

Texts are written once, each text once, in buckets of their names; the rounds shuffle only sets to them, never texts, at every size of input.
Each round is a grouping by core and one by hull. Of equal hulls one stands for all in later rounds, so a hot passage costs no more than its
distinct surroundings. Equal texts are one text that repeats as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm import words
from quaverlake.llm.tables import bucketed, map_batches, sized, spare, written

#: Bytes of a long text looked at together; windows that cross the end are seen with the next part.
PART_BYTES = 1 << 17
#: Windows of a set in the rounds after the first.
SETS = (32, 8, 1)

BLOCKS = "core long, hull long, node long, first long, last long, place long, need boolean"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` successive values."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _runs(data: np.ndarray, bounds: np.ndarray, length: int, anchor: int) -> tuple[words.Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, row, first window, last window, chosen place) of each run; positions are those in ``data``."""
    names = words.Rolling(data)
    at = np.arange(len(data) - anchor + 1)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    rough = (names.sums[at + anchor] - names.sums[at]) * names.down[at] * np.uint64(0x9FB21C651E98DF25)
    rough ^= rough >> np.uint64(32)
    key = (rough * np.uint64(0x9E3779B97F4A7C15) >> bits << bits) | at.astype(np.uint64)
    chosen = (_least(key, length - anchor + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(bounds)
    rows = np.flatnonzero(sizes >= length)
    counts = sizes[rows] - length + 1
    into = np.concatenate(([0], np.cumsum(counts)))
    window = np.arange(into[-1]) + np.repeat(bounds[rows] - into[:-1], counts)
    place = chosen[window]
    new = np.ones(len(window), bool)
    new[1:] = place[1:] != place[:-1]
    new[into[:-1]] = True
    start = np.flatnonzero(new)
    end = np.concatenate((start[1:], [len(window)])) - 1
    return names, np.repeat(rows, counts)[start], window[start], window[end], place[start]


def _named(names: words.Rolling, first: np.ndarray, last: np.ndarray, place: np.ndarray, size: int, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Core and hull of sets whose windows lie in one aligned block of ``size`` offsets before their place."""
    most = length - anchor
    block = (place - last) // size
    near, far = block * size, np.minimum(block * size + size - 1, most)
    core = words.mix(names.names(place - near, place - far + length) + block.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    hull = words.mix(names.names(first, last + length) + (place - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return core.astype(np.int64), hull.astype(np.int64)


def _parts(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds, position of each row's first byte in its text): short texts together, a long one in overlapping parts."""
    for first, data, offsets in words.text_slices(column, PART_BYTES):
        if len(offsets) == 2 and len(data) > PART_BYTES + length:
            for begin in range(0, len(data) - length + 1, PART_BYTES):
                part = data[begin:begin + PART_BYTES + length - 1]
                yield np.array([first]), part, np.array([0, len(part)]), np.array([begin])
        else:
            n = len(offsets) - 1
            yield np.arange(first, first + n), data, offsets, np.zeros(n, np.int64)


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["core", "hull", "node", "first", "last", "place", "need"])


def _all_runs(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Blocks of the first round: every run of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for rows, data, bounds, begin in _parts(batch.column(1), length):
                if len(data) < length:
                    continue
                names, row, first, last, place = _runs(data, bounds, length, anchor)
                if len(row):
                    core, hull = _named(names, first, last, place, 1 << 20, length, anchor)
                    shift = begin[row] - bounds[row]
                    yield _batch(core, hull, nodes[rows[row]], first + shift, last + shift, place + shift, np.ones(len(row), bool))

    return map_batches(texts, ["node", "text"], work, BLOCKS)


def _cut(texts: DataFrame, sets: DataFrame, size: int, length: int, anchor: int) -> DataFrame:
    """Blocks of a later round: the given sets (node, first, last, place, need) cut by offset, named from their texts."""
    code = F.shiftleft("first", 21) + F.shiftleft(F.col("last") - F.col("first"), 11) + F.shiftleft(F.col("place") - F.col("first"), 1) + F.col("need").cast("long")
    by_text = sets.groupBy("node").agg(F.collect_list(code).alias("sets"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text, item in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                sets_ = item.values.to_numpy()
                first = sets_ >> 21
                last, place, need = first + (sets_ >> 11 & 1023), first + (sets_ >> 1 & 1023), (sets_ & 1).astype(bool)
                low = (place - last) // size
                counts = (place - first) // size - low + 1
                at = np.repeat(np.arange(len(first)), counts)
                block = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + low[at]
                begin = np.maximum(first[at], place[at] - block * size - size + 1)
                end = np.minimum(last[at], place[at] - block * size)
                order = np.argsort(begin, kind="stable")
                at, begin, end = at[order], begin[order], end[order]
                done = 0
                while done < len(at):  # a stretch of the text at a time
                    origin = max(0, int(begin[done]) - length)
                    upto = int(np.searchsorted(begin, origin + PART_BYTES, "right"))
                    upto = max(upto, done + 1)
                    part = slice(done, upto)
                    names = words.Rolling(data[origin:int(end[part].max()) + 2 * length])
                    core, hull = _named(names, begin[part] - origin, end[part] - origin, place[at[part]] - origin, size, length, anchor)
                    yield _batch(core, hull, np.full(upto - done, node, np.int64), begin[part], end[part], place[at[part]], need[at[part]])
                    done = upto

    return map_batches(texts.join(by_text.hint("shuffle_hash"), "node"), ["node", F.col("text").cast("binary").alias("text"), "sets"], work, BLOCKS)


def _ranked(blocks: DataFrame) -> DataFrame:
    """Cores that occur more than once, and whether their hulls differ (``mixed``)."""
    return written(blocks.groupBy("core").agg(F.count("*").alias("c"), F.min("hull").alias("lo"), F.max("hull").alias("hi"), F.max("need").alias("asked"))
                   .where("c > 1 AND asked").select("core", (F.col("lo") != F.col("hi")).alias("mixed")))


def _settled(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows that repeat, sets to be cut) of written blocks that know whether their core is mixed."""
    alike = blocks.where("need AND NOT mixed").select("node", "first", "last")
    mixed = blocks.where("mixed")
    hulls = written(mixed.groupBy("core", "hull").agg(F.count("*").alias("c"), F.max("need").alias("need"), F.min(F.struct("node", "first", "last", "place")).alias("at"))
                    .withColumn("open", F.expr("need AND c = 1")))
    found = mixed.where("need").join(hulls.where("c > 1").select("core", "hull").hint("merge"), ["core", "hull"], "left_semi").select("node", "first", "last")
    rest = hulls.join(hulls.where("open").select("core").distinct().hint("merge"), "core", "left_semi").select("at.*", F.col("open").alias("need"))
    return alike.union(found), rest


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(node, text, c) of each text once with its count, in buckets of node. ``texts`` has node (a name of the text) and text."""
    return bucketed(texts.groupBy("node").agg(F.first("text").alias("text"), F.count("*").alias("c")), "node")


def repeated_windows(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(node, first, last): ranges of windows of ``length`` bytes that start in two places or more. ``texts`` has node (a name of the text) and text."""
    return windows_of_distinct(distinct_texts(texts), length, anchor)


def windows_of_distinct(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """``repeated_windows`` of what ``distinct_texts`` gives."""
    if not 0 < length - anchor < 1024:
        raise ValueError("length must be above anchor by less than 1024")
    first = written(_all_runs(texts, length, anchor).join(_ranked(_all_runs(texts, length, anchor)).hint("merge"), "core"))
    found, rest = _settled(first)
    ranges = [found]
    for size in SETS:
        blocks = written(_cut(texts, rest, size, length, anchor))
        found, rest = _settled(written(blocks.join(_ranked(blocks).hint("merge"), "core")))
        ranges.append(found)
    whole = (F.octet_length("text").cast("long") - length).alias("last")
    out = texts.where("c > 1").select("node", F.lit(0).cast("long").alias("first"), whole).where("last >= 0")
    for one in ranges:
        out = out.union(one)
    return out


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, anchor: int = 40, keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row: its text without the bytes of repeated strings.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in this text or another, as the input has them; strings do
    not cross texts. ``kept`` is the rest as text (bytes of characters that were cut in two are left out of ``kept`` alone). Repeated rows
    repeat each other wholly; a null text counts as empty; shorter texts than ``length`` stay as they are; null ids are carried; other
    columns aren't read; an empty table gives no rows.
    """
    kind = "string" if docs.schema[id_col].dataType.simpleString() == "string" else "long"
    named = docs.select(F.col(f"`{id_col}`").cast(kind).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    texts = distinct_texts(named.select("node", "text"))
    by_text = (windows_of_distinct(texts, length, anchor).distinct().groupBy("node").agg(F.flatten(F.collect_list(F.array("first", "last"))).alias("ranges")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, item in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer()
                n = len(data)
                removed = spans = 0
                kept = data
                if item.is_valid:
                    first, last = item.values.to_numpy().reshape(-1, 2).T
                    change = np.zeros(n + 1, np.int32)
                    np.add.at(change, first, 1)
                    np.add.at(change, last + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (n, removed, spans, hashlib.sha256(kept).hexdigest(), bytes(kept).decode("utf-8", "ignore") if keep_text else None), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["node", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    got = map_batches(texts.join(by_text.hint("shuffle_hash"), "node", "left"), ["node", F.col("text").cast("binary").alias("text"), "ranges"], work,
                      "node long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    got = named.select("id", "node").join(got if keep_text else got.drop("kept"), "node").drop("node")
    return got.withColumnRenamed("id", id_col)


def strip_repeats(docs: DataFrame, *, text_col: str = "text", length: int = 200, anchor: int = 40) -> DataFrame:
    """``docs`` with all columns, the text without the bytes that ``without_repeats`` removes; a null text stays null."""
    names = docs.columns
    node, held = spare(docs, "__node"), spare(docs, "__ranges")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ranges = repeated_windows(docs.select(F.xxhash64(text).alias("node"), text.alias("text")), length, anchor)
    by_text = written(ranges.distinct().groupBy(F.col("node").alias(node)).agg(F.flatten(F.collect_list(F.array("first", "last"))).alias(held)))
    at = names.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, item in enumerate(batch.column(len(names))):
                if item.is_valid:
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    first, last = item.values.to_numpy().reshape(-1, 2).T
                    change = np.zeros(len(data) + 1, np.int32)
                    np.add.at(change, first, 1)
                    np.add.at(change, last + length, -1)
                    texts[i] = data[np.cumsum(change[:-1]) == 0].tobytes().decode("utf-8", "ignore")
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = docs.withColumn(node, F.xxhash64(text)).join(sized(by_text), node, "left")
    return map_batches(joined, [*[F.col(f"`{c}`") for c in names], held], work, docs.schema)
