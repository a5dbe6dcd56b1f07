"""Ranked lexical search: sums over short lists materialised first, then one bounded iterator beside the long lists, which are skipped in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaverlake.llm.tables import map_batches, written
from quaverlake.llm.words import _LOWER, SLICE_BYTES, Rolling, spans, text_slices

#: A segment of the index is closed at so many documents or bytes of text.
SEGMENT_DOCS, SEGMENT_BYTES = 8192, 32 << 20
#: Documents of a block whose greatest scores are kept.
BLOCK = 64
#: A list is short in a segment if it holds at most one document in so many.
SHORT_SHARE = 32
#: Distinct terms of queries that are looked for in one pass.
BLOCK_TERMS = 200_000
#: Parts that the best rows of one query are combined in before they meet.
SALTS = 64

#: Bytes of terms: digits, A-Z, a-z and all that isn't ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SCALE, _B = 1_000_000_000, 75


def _term_names(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, names of terms) in order, for some megabytes of text at a time; a long text is cut between terms."""
    first = 0
    while first < len(data):
        last = min(len(data), first + limit)
        if last < len(data):
            breaks = np.flatnonzero(~TERM[data[first:last]])
            if len(breaks):
                last = first + int(breaks[-1]) + 1
            else:  # one term fills the part; it ends at the next break
                more = np.flatnonzero(~TERM[data[last:]])
                last = last + int(more[0]) if len(more) else len(data)
        part = _LOWER[data[first:last]]
        cut = np.zeros(len(part) + 1, bool)
        inner = offsets[np.searchsorted(offsets, first):np.searchsorted(offsets, last, "right")]
        cut[inner - first] = True
        cut[0] = cut[-1] = True
        starts, ends = spans(TERM[part], cut)
        yield np.searchsorted(offsets, starts + first, "right") - 1, Rolling(part).names(starts, ends)
        first = last


@dataclass
class _Segment:
    """Documents gathered so far, and the places where terms asked for occur."""

    ids: list
    lengths: list
    docs: list
    terms: list
    counts: list
    size: int = 0
    rows: int = 0

    @classmethod
    def empty(cls) -> _Segment:
        return cls([], [], [], [], [])

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> None:
        rows = len(offsets) - 1
        lengths = np.zeros(rows, np.int64)
        keys = [np.zeros(0, np.int64)]
        for row, names in _term_names(data, offsets):
            lengths += np.bincount(row, minlength=rows)
            at = np.minimum(np.searchsorted(wanted, names), len(wanted) - 1)
            hit = wanted[at] == names
            keys.append(row[hit] * len(wanted) + at[hit])
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.docs.append(keys // len(wanted) + self.rows)
        self.terms.append((keys % len(wanted)).astype(np.int32))
        self.counts.append(counts)
        self.rows += rows
        self.size += len(data)

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        """The segment as one row: lists by term, each ascending by place; places follow the ids, nulls last."""
        ids = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in self.ids])
        order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        docs, terms, counts = place[np.concatenate(self.docs)], np.concatenate(self.terms), np.concatenate(self.counts)
        by = np.lexsort((docs, terms))
        docs, terms, counts = docs[by], terms[by], counts[by]
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(terms)))
        lengths = np.concatenate(self.lengths)[order]

        def held(x: np.ndarray, of: pa.DataType) -> pa.Array:
            return pa.array([x], pa.list_(of))

        return pa.RecordBatch.from_arrays(
            [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids.take(pa.array(order))).cast(pa.list_(kind)),
             held(lengths, pa.int64()), held(terms[starts], pa.int32()), held(sizes, pa.int32()), held(docs, pa.int32()), held(counts, pa.int32())],
            ["n_docs", "n_terms", "ids", "lengths", "terms", "sizes", "docs", "counts"])


def _index(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    now, kind = _Segment.empty(), None
    for batch in batches:
        kind = batch.column(0).type
        for first, data, offsets in text_slices(batch.column(1)):
            now.add(batch.column(0).slice(first, len(offsets) - 1), data, offsets, wanted)
            if now.rows >= SEGMENT_DOCS or now.size >= SEGMENT_BYTES:
                yield now.row(kind)
                now = _Segment.empty()
    if now.rows:
        yield now.row(kind)


def _contributions(weight: int, counts: np.ndarray, damp: np.ndarray) -> np.ndarray:
    return weight * ((_SCALE * counts) // (1000 * counts + 8 * damp))


class _Lists:
    """The lists of one segment with the scores of a single occurrence of their term in a query, and the greatest score of each block."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int):
        self.n = len(row["lengths"])
        self.blocks = -(-self.n // BLOCK)
        damp = (100 - _B) + (_B * row["lengths"] * n) // max(total, 1)
        ends = np.cumsum(row["sizes"])
        self.at = {}
        for term, start, end in zip(row["terms"].tolist(), (ends - row["sizes"]).tolist(), ends.tolist()):
            docs = row["docs"][start:end]
            self.at[term] = docs, _contributions(int(weights[term]), row["counts"][start:end].astype(np.int64), damp[docs])
        self._tops: dict[int, np.ndarray] = {}

    def tops(self, term: int) -> np.ndarray:
        got = self._tops.get(term)
        if got is None:
            docs, scores = self.at[term]
            got = np.zeros(self.blocks, np.int64)
            np.maximum.at(got, docs // BLOCK, scores)
            self._tops[term] = got
        return got

    def best(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents of the segment with a score above 0, best first, ties by place.

        The short lists are added up first. Their sums are one list more from here on, with its own greatest sum of each block. Blocks of all
        lists are taken in order of documents; one whose bound, the greatest sum and the greatest scores of the long lists together, is below the
        k-th best score known is skipped. In a block that is opened, long lists are added by falling bound, and only documents that can still
        reach that score stay. Nothing that could be among the k best is left out, ties included.
        """
        mine = [(len(self.at[t][0]), t, times) for t, times in query if t in self.at]
        short = [x for x in mine if x[0] * SHORT_SHARE <= self.n]
        long = [x for x in mine if x[0] * SHORT_SHARE > self.n]
        sums = np.zeros(self.n, np.int64)
        for _, t, times in short:
            docs, scores = self.at[t]
            sums[docs] += times * scores
        bound = np.zeros(self.blocks * BLOCK, np.int64)
        bound[:self.n] = sums
        bound = bound.reshape(self.blocks, BLOCK).max(axis=1) if self.blocks else bound
        tops = [(times * self.tops(t), t, times) for _, t, times in long]
        tops.sort(key=lambda x: -int(x[0].max(initial=0)))
        for top, _, _ in tops:
            bound = bound + top
        rest = np.cumsum([0, *[int(x[0].max(initial=0)) for x in tops][::-1]])[::-1]
        least = max(1, int(np.partition(sums, self.n - k)[self.n - k])) if self.n >= k else 1
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = 8
        at = 0
        open_blocks = np.flatnonzero(bound >= least)
        while at < len(open_blocks):
            blocks = open_blocks[at:at + step]
            at += step
            blocks = blocks[bound[blocks] >= least]
            if not len(blocks):
                continue
            docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            docs = docs[docs < self.n]
            got = sums[docs]
            for (_, t, times), after in zip(tops, rest[:-1].tolist()):
                stay = got + after >= least
                if not stay.all():
                    docs, got = docs[stay], got[stay]
                    if not len(docs):
                        break
                have, value = self.at[t]
                low, high = np.searchsorted(have, docs[0]), np.searchsorted(have, docs[-1], "right")
                near = np.searchsorted(docs, have[low:high])
                near[near == len(docs)] = 0
                hit = docs[near] == have[low:high]
                got[near[hit]] += times * value[low:high][hit]
            good = got >= least
            places, scores = np.concatenate([places, docs[good]]), np.concatenate([scores, got[good]])
            order = np.lexsort((places, -scores))[:k]
            places, scores = places[order], scores[order]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
            step = min(2 * step, 1024)
        return places, scores


def _score(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, list[tuple[int, int]]]], weights: np.ndarray, n: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("lengths", "terms", "sizes", "docs", "counts")}
            ids, lists = batch.column("ids")[i].values, _Lists(row, weights, n, total)
            query, place, score = [], [], []
            for q, terms in queries:
                places, scores = lists.best(terms, k)
                query.append(np.full(len(places), q))
                place.append(places)
                score.append(scores)
            if query:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query), pa.int64()), ids.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(score), pa.int64())], ["query", "id", "score"])


def terms_of(text: Column) -> Column:
    """The terms of a text, with repeats: runs of digits, letters and all that isn't ASCII, with A-Z in lower case; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))


def _names_of(terms: list[str]) -> np.ndarray:
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return Rolling(data).names(np.concatenate(([0], ends[:-1])).astype(np.int64), ends)


def _weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item id, rank, document id, score): for each row of ``items`` the k documents of highest score above 0, equal scores by ascending id.

    N documents have a term, L terms in all, n in one; a term stands in df documents, tf times in this one. Its weight is
    floor(1000 * ln((2N + 2) / (2df + 1))); with m = 25 + (75 * n * N) div L a document scores the sum, over the item's terms with repeats, of
    weight * ((10**9 * tf) div (1000 * tf + 8 * m)). Ranks go from 1 and are unique. Rows are documents and items of their own, repeated ones too; a null id comes
    after all others; null and empty texts have no terms. Empty tables give an empty result; other columns aren't read.

    The items are a set of queries held against all documents, in blocks of about ``block_terms`` distinct terms. For a block each task turns the
    documents that it reads into segments of the index (documents by id, the lists of the terms asked for); the segments go to the shared folder.
    Counts of the corpus are summed over all segments, then each segment gives its k best for each item, and these are combined in two steps.
    Terms meet by 64-bit names, which differ for different terms but for chance.
    """
    spark = docs.sparkSession
    asked = written(items.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{item_id}`").alias("item"), terms_of(F.col(f"`{item_text}`").cast("string")).alias("terms")))
    used = asked.select("query", F.explode("terms").alias("term")).groupBy("query", "term").count()
    total_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-total_terms // block_terms))
    id_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    blocks = []
    for part in range(parts):
        mine = [(r.query, r.term, r["count"]) for r in used.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).collect()]
        if not mine:
            continue
        words = sorted({t for _, t, _ in mine})
        names = _names_of(words)
        order = np.argsort(names)
        wanted, number = names[order], {words[x]: i for i, x in enumerate(order.tolist())}
        queries: dict[int, list[tuple[int, int]]] = {}
        for q, t, times in mine:
            queries.setdefault(q, []).append((number[t], times))
        blocks.append(_block_best(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{doc_text}`").cast("string").alias("text")), sorted(queries.items()), wanted, id_kind, k))
    if not blocks:
        return spark.createDataFrame([], f"`{item_id}` {item_kind}, rank int, `{doc_id}` {id_kind}, score long")
    found = blocks[0]
    for more in blocks[1:]:
        found = found.unionByName(more)
    best = _top(_top(found.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS))), ["query", "salt"], k).drop("salt", "rank"), ["query"], k)
    return best.join(asked.select("query", "item"), "query").select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_best(docs: DataFrame, queries: list, wanted: np.ndarray, id_kind: str, k: int) -> DataFrame:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _index(batches, wanted)

    segments = written(map_batches(docs, ["id", "text"], index,
                                   f"n_docs long, n_terms long, ids array<{id_kind}>, lengths array<long>, terms array<int>, sizes array<int>, docs array<int>, counts array<int>"))
    n, total = (x or 0 for x in segments.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    weights = np.zeros(len(wanted), np.int64)
    pairs = segments.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy("p.terms").agg(F.sum("p.sizes").alias("df"))
    for term, df in pairs.collect():  # a row for each term asked for at most
        weights[term] = _weight(n, df)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(batches, queries, weights, n, total, k)

    return map_batches(segments, ["ids", "lengths", "terms", "sizes", "docs", "counts"], score, f"query long, id {id_kind}, score long")
