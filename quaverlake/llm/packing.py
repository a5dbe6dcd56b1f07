"""Vector bin packing of token sequences under simultaneous limits on tokens, segments and loss-bearing tokens.

Examples are cut where a sequence has room left, so no example is too long and little room is lost. Within a bounded window of examples the
next piece of a sequence is the one whose demand vector has the largest dot product with the room that the sequence still has.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm import words
from quaverlake.llm.tables import map_batches


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and how many examples and tokens are looked at together."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    window_examples: int = 1024
    window_tokens: int = 1 << 19


@dataclass
class Example:
    """Tokens ``start`` to the end of ``ids`` are still to be placed; ``loss`` counts the loss-bearing tokens before each place."""

    key: object
    ids: np.ndarray
    loss: np.ndarray
    start: int = 0

    def demand(self) -> tuple[int, int]:
        return len(self.ids) - self.start, int(self.loss[-1] - self.loss[self.start])

    def fitting(self, tokens: int, loss: int) -> int:
        """Tokens of the longest beginning that keeps both limits."""
        end = int(np.searchsorted(self.loss, self.loss[self.start] + loss, "right")) - 1
        return max(0, min(tokens, len(self.ids) - self.start, end - self.start))


Piece = tuple[Example, int, int]


def pack_window(examples: list[Example], limits: Limits) -> Iterator[list[Piece]]:
    """Sequences as lists of (example, start, length); the last one may have room left, and each earlier one is full in some dimension.

    Every example must have at least one token. Ties take the earlier example.
    """
    whole = np.array([limits.tokens, limits.segments, limits.loss], float)
    n = len(examples)
    need = np.ones((n, 3))
    for i, x in enumerate(examples):
        need[i, [0, 2]] = x.demand()
    need /= whole
    alive = np.ones(n, bool)
    left = n
    while left:
        bin_, room = [], [limits.tokens, limits.segments, limits.loss]
        while left and room[0] and room[1]:
            free = np.array(room) / whole
            score = need @ free
            fits = alive & (need <= free + 1e-12).all(axis=1)
            best = int(np.argmax(np.where(fits, score, -1.0)))
            if not fits[best]:
                # nothing fits whole: cut the example that asks for most of what is left; those whose next token bears loss need loss room
                best = int(np.argmax(np.where(alive, score, -1.0)))
                if not room[2]:
                    free_start = next((i for i in np.flatnonzero(alive) if examples[i].fitting(room[0], 0)), None)
                    if free_start is None:
                        break
                    best = int(free_start)
            x = examples[best]
            take = x.fitting(room[0], room[2])
            bin_.append((x, x.start, take))
            before = x.demand()
            x.start += take
            after = x.demand()
            room = [room[0] - take, room[1] - 1, room[2] - (before[1] - after[1])]
            if after[0]:
                need[best, 0], need[best, 2] = after[0] / whole[0], after[1] / whole[2]
            else:
                alive[best] = False
                left -= 1
        yield bin_


def _open_room(bin_: list[Piece], limits: Limits) -> bool:
    tokens = sum(p[2] for p in bin_)
    loss = sum(int(x.loss[s + n] - x.loss[s]) for x, s, n in bin_)
    return tokens < limits.tokens and len(bin_) < limits.segments and loss < limits.loss


def pack_stream(examples: Iterator[Example], limits: Limits) -> Iterator[list[Piece]]:
    """Packs a stream of examples window by window; a window's unfilled sequence goes into the next window."""
    held: list[Example] = []
    tokens = 0

    def rest(bin_: list[Piece]) -> list[Example]:
        return [Example((x.key, x, s), x.ids[s:s + n], x.loss[s:s + n + 1]) for x, s, n in bin_]

    def origin(piece: Piece) -> Piece:
        x, s, n = piece
        while isinstance(x.key, tuple) and len(x.key) == 3 and isinstance(x.key[1], Example):
            x, s = x.key[1], x.key[2] + s
        return x, s, n

    def flush(last: bool) -> Iterator[list[Piece]]:
        nonlocal held, tokens
        work, held, tokens = held, [], 0
        for bin_ in pack_window(work, limits):
            if not last and _open_room(bin_, limits):
                held = rest([origin(p) for p in bin_])
                tokens = sum(p[2] for p in bin_)
            else:
                yield [origin(p) for p in bin_]

    for x in examples:
        held.append(x)
        tokens += len(x.ids) - x.start
        if len(held) >= limits.window_examples or tokens >= limits.window_tokens:
            yield from flush(False)
    if held:
        yield from flush(True)


class Encoder:
    """Ids of a tokenizer that treats text between blanks on its own, with a bounded memory of the chunks seen before.

    Chunks end at white space and between an ASCII letter or digit and other ASCII marks (not the apostrophe, which starts endings of
    English words). The ids of a text are those of its chunks in order. A text that holds the name of a special token is encoded whole.
    """

    def __init__(self, path: str, memory: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        #: Names of known chunks, ascending, and the slot of each: 12 bytes a chunk.
        self.names, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.int32)
        self.begin = np.zeros((1 << 14) + 1, np.int32)

    def _learn(self, names: np.ndarray, chunks: list[str]) -> None:
        """``names`` ascending, none of them known."""
        have = len(self.slots)
        got = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        end = self.begin[have] + np.cumsum(sizes)
        if len(self.begin) <= have + len(got):
            self.begin = np.concatenate([self.begin, np.zeros(max(len(self.begin) // 2, len(got)), np.int32)])
        if len(self.flat) < end[-1]:
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat) // 2, int(sizes.sum())), self.flat.dtype)])
        self.flat[self.begin[have]:end[-1]] = np.fromiter((i for ids in got for i in ids), self.flat.dtype, int(sizes.sum()))
        self.begin[have + 1:have + 1 + len(got)] = end
        at = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, at, names)
        self.slots = np.insert(self.slots, at, np.arange(have, have + len(got), dtype=np.int32))

    def slice_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's ids begin, with the end last)."""
        starts, ends = words.chunk_spans(data, offsets)
        names = words.Rolling(data).names(starts, ends)
        unique, first, where = np.unique(names, return_index=True, return_inverse=True)
        if len(self.names) + len(unique) > self.memory:
            self._forget()
        at = np.searchsorted(self.names, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == unique[inside]
        if not known.all():
            raw, new = data.tobytes(), first[~known]
            self._learn(unique[~known], [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.names, unique)
        slot = self.slots[at][where]
        sizes = self.begin[slot + 1] - self.begin[slot]
        out = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        ids = self.flat[np.arange(out[-1]) + np.repeat(self.begin[slot] - out[:-1], sizes)].astype(np.int32)
        return ids, out[np.searchsorted(starts, offsets)]

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow column; a null has none."""
        for _, data, offsets in words.text_slices(column):
            raw = data.tobytes()
            ids, bounds = self.slice_ids(data, offsets)
            odd = any(s in raw for s in self.special)
            for i in range(len(offsets) - 1):
                if odd and any(s in raw[offsets[i]:offsets[i + 1]] for s in self.special):
                    text = raw[offsets[i]:offsets[i + 1]].decode("utf-8", "replace")
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                else:
                    yield ids[bounds[i]:bounds[i + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PACKED = ("{id} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, "
          "sequence_segments long, sequence_loss long")


def _emit(sequences: Iterator[list[Piece]], kind: pa.DataType, id_col: str) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_segments", "sequence_loss"]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

    for number, pieces in enumerate(sequences):
        tokens = sum(p[2] for p in pieces)
        loss = sum(int(x.loss[s + n] - x.loss[s]) for x, s, n in pieces)
        offset = 0
        for x, s, n in pieces:
            rows.append((x.key, s, n, zlib.crc32(x.ids[s:s + n].astype("<u4").tobytes()), len(x.ids), base + number, offset, tokens, len(pieces), loss))
            offset += n
        if len(rows) >= 8192:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def pack_texts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, prompt_col: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Packs the tokenized texts of a stored table; one row for each piece.

    An example is the ids of its prompt, those of its text, and ``end_id``; the prompt's ids bear no loss, the others do (all, without
    ``prompt_col``). Each task packs the rows that it reads, in their order, so no text is shuffled and what a task holds is bounded by one
    window. The input must be a table (or another plan whose tasks see the same rows in the same order when they are run again): then a
    lost task makes the same sequences again. Every row counts, repeated ids too; a null text or prompt is empty, so such a row has the
    end id alone; a null id is carried. An empty table gives no rows. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType
    columns = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"), (F.col(f"`{prompt_col}`") if prompt_col else F.lit(None)).cast("string").alias("prompt")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = encoder(tokenizer)

        def examples() -> Iterator[Example]:
            for batch in batches:
                for key, ids, prompt in zip(batch.column(0).to_pylist(), ready.rows(batch.column(1)), ready.rows(batch.column(2)), strict=True):
                    bearing = np.arange(-len(prompt), len(ids) + 2).clip(0)
                    yield Example(key, np.concatenate([prompt, ids, [end_id]]).astype(np.int32), bearing)

        kind = pa.string() if id_type.simpleString() == "string" else pa.int64()
        yield from _emit(pack_stream(examples(), limits), kind, id_col)

    return map_batches(docs, columns, work, PACKED.format(id=f"`{id_col}`", kind="string" if id_type.simpleString() == "string" else "long"))


def pack_tokens(examples: DataFrame, *, id_col: str, ids_col: str, loss_col: str, limits: Limits = Limits()) -> DataFrame:
    """The same for examples that have their ids and, for each id, whether it bears loss (a null or missing mark: it doesn't).

    An example without ids (empty or null) has nothing to place and gives no row.
    """
    columns = [F.col(f"`{id_col}`").cast("string"), F.col(f"`{ids_col}`").cast("array<int>"), F.col(f"`{loss_col}`").cast("array<int>")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples_of() -> Iterator[Example]:
            for batch in batches:
                for key, ids, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if ids:
                        bears = np.zeros(len(ids), np.int64)
                        known = (marks or [])[:len(ids)]
                        bears[:len(known)] = [bool(m) for m in known]
                        yield Example(key, np.array(ids, np.int32), np.concatenate(([0], np.cumsum(bears))))

        yield from _emit(pack_stream(examples_of(), limits), pa.string(), id_col)

    return map_batches(examples, columns, work, PACKED.format(id=f"`{id_col}`", kind="string"))

