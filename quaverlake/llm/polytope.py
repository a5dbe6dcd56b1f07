"""Approximate nearest neighbours by cross-polytope hashing: a pseudo-random rotation takes a unit vector to the nearest signed axis.

A rotation is three rounds of random signs and a fast Hadamard transform. A table hashes by the nearest axes of one rotation, or of several for
very large collections; a query probes the axes (or tuples of axes) that it is nearest to. Candidates are ranked by their exact inner products with the original vectors.

Rows are hashed by direction alone. What a long row may still reach at a wide angle is bounded by its length: rows long enough to be among the best at an
angle that the tables often miss are compared exactly, in bands of length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.tables import written
from quaverlake.session import ship_package

#: Vectors, and queries, that are compared at a time.
BLOCK = 2048
#: Components of the vectors that a task holds as one block of rows, or of queries.
HELD = 1 << 21
#: Blocks of rows to a core, where they have ``BLOCK`` rows still.
SHARES = 2
#: Share of the neighbours at an angle that the tables must find; at wider angles rows are compared exactly.
FOUND = 0.9
#: Bands of length to a doubling.
BANDS = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each column, scaled to keep lengths; the height is a power of two."""
    width, n = x.shape
    step = 1
    while step < width:
        y, out = x.reshape(width // (2 * step), 2, step, n), np.empty((width // (2 * step), 2, step, n))
        np.add(y[:, 0], y[:, 1], out=out[:, 0])
        np.subtract(y[:, 0], y[:, 1], out=out[:, 1])
        x = out.reshape(width, n)
        step *= 2
    return x / np.sqrt(width)


def largest(values: np.ndarray, k: int) -> np.ndarray:
    """The columns of the ``k`` largest values of each row, largest first; of equal ones the first."""
    values, row, at = values.copy(), np.arange(len(values)), []
    for _ in range(k):
        at.append(values.argmax(axis=1))
        values[row, at[-1]] = -np.inf
    return np.stack(at, axis=1)


class Tables:
    """The rotations of all tables, the same on every machine."""

    def __init__(self, dims: int, tables: int, probes: int, rotations: int, seed: int = 11):
        self.width = 1 << max(1, int(np.ceil(np.log2(dims))))
        self.tables, self.probes, self.rotations, self.dims = tables, probes, rotations, dims
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, rotations, 3, self.width))

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        """The directions of the rows, filled up to the width."""
        out = np.zeros((len(vectors), self.width))
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        out[:, :vectors.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        return out

    def least_cosine(self, pairs: int = 1000) -> float:
        """The smallest cosine at which a query finds a row with a chance of ``FOUND``, measured on random pairs."""
        r = np.random.default_rng(5)
        a = self.unit(r.normal(size=(pairs, max(2, self.dims))))
        b = self.unit(r.normal(size=(pairs, max(2, self.dims))))
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        asked = self.buckets(a, self.probes)
        low, high = 0.0, 1.0
        for _ in range(7):
            middle = (low + high) / 2
            held = self.buckets(middle * a + np.sqrt(1 - middle * middle) * b, 1)
            low, high = (low, middle) if (asked == held).any(axis=(0, 2)).sum() >= FOUND * pairs else (middle, high)
        return high

    def _near(self, x: np.ndarray, table: int, rotation: int) -> np.ndarray:
        """How near each signed axis is."""
        x = np.ascontiguousarray(x.T)
        for k in range(3):
            x = hadamard(x * self.signs[table, rotation, k][:, None])
        return np.vstack([x, -x]).T

    def buckets(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """By table and row the best ``probes`` tuples of axes, by the sum of their nearness."""
        parts = [self._tuples(unit[first:first + 512], probes) for first in range(0, len(unit), 512)]
        return np.concatenate(parts, axis=1)

    def _tuples(self, unit: np.ndarray, probes: int) -> np.ndarray:
        axes, few = 2 * self.width, min(2 * self.width, probes)
        keys = []
        for table in range(self.tables):
            bucket, total = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
            for rotation in range(self.rotations):
                near = self._near(unit, table, rotation)
                at = largest(near, few)
                total = (total[:, :, None] + np.take_along_axis(near, at, axis=1)[:, None, :]).reshape(len(unit), -1)
                bucket = (bucket[:, :, None] * axes + at[:, None, :]).reshape(len(unit), -1)
                if total.shape[1] > probes:
                    top = np.argsort(-total, axis=1, kind="stable")[:, :probes]
                    total, bucket = np.take_along_axis(total, top, axis=1), np.take_along_axis(bucket, top, axis=1)
            keys.append(bucket)
        return np.stack(keys)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.values if column.offset == 0 and len(column.values) == len(column) * dims else column.flatten()).reshape(len(column), dims).astype(float)


def valid_vectors(table: DataFrame, *, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, floats or doubles) of the rows that take part: no null id or vector, no null, infinite or undefined component, not all zero."""
    floats = table.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(f"`{vector_col}`").cast("array<float>" if floats else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull()) & (_longest(v) > 0) & (_longest(v) < float("inf"))  # undefined is more than infinite
    return table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine)


def _longest(vector: Column) -> Column:
    """The largest absolute component."""
    return F.greatest(F.array_max(vector), F.negative(F.array_min(vector))).cast("double")


def nearest(table: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = 16, probes: int = 7, rotations: int = 1) -> DataFrame:
    """(query_id, rank, id, score): for each query row the ``k`` nearest other rows found, by inner product; ties go to the smaller id.

    Every valid row is in the index and in ``tables`` buckets; a query asks ``probes`` buckets of each table. There are twice as many buckets in
    a table as dimensions, to the power of ``rotations``. Rows are dealt to blocks and queries to turns of a bounded size; a task hashes those of one
    block and turn and compares what meets in a bucket, and the block's best ``k`` for each query go on, so no vector moves with each of its buckets and no pair leaves a task but those.
    Then each query is compared with all rows, in bands of length and in blocks, that are long enough to reach its ``k``-th best product so far at an
    angle where the tables find less than ``FOUND`` of the rows; one that found fewer than ``k`` rows is compared with all. So vectors of any lengths are
    found as often as those of one length. A repeated id counts as one row for
    ranking if its vector is the same, and as two rows else; a query is no candidate of its own id. Vectors of a width other than the most
    common take no part, like those that aren't valid. Without valid rows the result is empty. Other columns aren't read.
    """
    valid = valid_vectors(table, id_col=id_col, vector_col=vector_col).withColumn("query", is_query)
    # a column of its own, or it would be worked out again for each component
    valid = valid.withColumn("longest", _longest(F.col("vector")))
    length = F.col("longest") * F.sqrt(F.aggregate(F.transform("vector", lambda x: x.cast("double") / F.col("longest")), F.lit(0.0), lambda s, x: s + x * x))
    rows = written(valid.withColumn("length", length).drop("longest").withColumn("band", F.floor(BANDS * F.log2("length")).cast("long")))
    shape = rows.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("c"), F.count_if("query").alias("asked")).orderBy(F.desc("c"), "dims").first()
    empty = table.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    if shape is None:
        return empty
    rows = rows.where(F.size("vector") == shape.dims)
    index = Tables(shape.dims, tables, probes, rotations)
    cores = table.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(shape.c * shape.dims / HELD), min(SHARES * cores, math.ceil(shape.c / BLOCK)))
    turns = max(1, math.ceil(shape.asked * shape.dims / HELD))
    best = written(_ranked(_hashed(rows, index, blocks, turns, k), k))

    # rows that could be among the best at an angle where the tables miss too many
    bands = rows.groupBy("band").agg(F.max("length").alias("longest")).collect()  # a few for each doubling of the length
    enough = min(k, shape.c - 1)
    least = F.negative(F.get("best", F.lit(enough - 1))["far"])
    asked = (rows.where("query").join(best, F.col("id") == F.col("query_id"), "left")
             .withColumn("from", F.coalesce(least / F.col("length") / F.lit(index.least_cosine()), F.lit(0.0))))
    reach = F.filter(F.array(*[F.struct(F.lit(b.band).alias("band"), F.lit(b.longest).alias("longest")) for b in bands]), lambda b: b["longest"] > F.col("from"))
    asked = asked.select(F.explode(reach).alias("b"), "id", "vector").select(F.col("b.band").alias("bucket"), "id", "vector")
    more = _met(rows.select(F.col("band").alias("bucket"), "id", "vector"), written(asked), k, shape.dims)

    known = best.select("query_id", F.explode("best").alias("b")).select("query_id", "b.id", F.negative("b.far").alias("score"))
    return (_ranked(known.union(more), k).select("query_id", F.posexplode("best").alias("pos", "b"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), F.negative("b.far").alias("score")))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, best): the ``k`` best (far, id) of each query, each once."""
    return found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.negative("score").alias("far"), "id"))), 1, k).alias("best"))


def _hashed(rows: DataFrame, index: Tables, blocks: int, turns: int, k: int) -> DataFrame:
    """(query_id, id, score): the best ``k`` rows of each block for each query, of those that it meets in a bucket."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    members = rows.select(dealt(blocks).alias("block"), each(turns).alias("turn"), "id", "vector")
    queries = rows.where("query").select(each(blocks).alias("block"), dealt(turns).alias("turn"), F.col("id").alias("asker"), F.col("vector").alias("asked"))

    def work(ids: np.ndarray, vectors: np.ndarray, who: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        held = index.buckets(index.unit(vectors), 1)[:, :, 0]
        orders = np.argsort(held, axis=1, kind="stable")
        apart = _apart(asked, vectors)
        for first in range(0, len(who), 2 * BLOCK):
            turn = slice(first, first + 2 * BLOCK)
            names, part, off = who[turn], asked[turn], apart[turn]
            wanted = index.buckets(index.unit(part), index.probes)
            found, least = [], np.full(len(names), -np.inf)
            for table, order in enumerate(orders):
                inside = vectors[order]
                for asking, start, end in _meetings(wanted[table], held[table][order]):
                    for at in range(start, end, BLOCK // 2):
                        some = order[at:min(end, at + BLOCK // 2)]
                        query, row, score = _closest(names[asking], part[asking], ids[some], inside[at:at + len(some)], least[asking], off[asking], k)
                        found.append((asking[query], some[row], score))
                if sum(len(x[0]) for x in found) > 2 * k * len(names):
                    found = [_cut(found, k)]
                    least = _last(*found[0], least, k)
            query, row, score = _cut(found, k)
            yield names[query], ids[row], score

    return _grouped(members, queries, ["block", "turn"], index.dims, work)


def _meetings(wanted: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(queries, start, end): for each bucket that both sides have, the queries that ask it and where its rows stand in ``held``, which is in order."""
    order = np.argsort(wanted.ravel(), kind="stable")
    buckets = wanted.ravel()[order]
    both = np.intersect1d(buckets, held)
    sides = [np.searchsorted(x, both, side) for x in (buckets, held) for side in ("left", "right")]
    for first, last, start, end in zip(*(x.tolist() for x in sides)):
        yield order[first:last] // wanted.shape[1], start, end


def _apart(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """What two orders of summing a product with one of ``held`` can differ by, twice."""
    return 8 * held.shape[1] * np.finfo(float).eps * np.linalg.norm(asked, axis=1) * np.linalg.norm(held, axis=1).max()


def _last(query: np.ndarray, row: np.ndarray, score: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """``least``, raised to the last score of the queries that have ``k`` rows."""
    full = np.flatnonzero(np.bincount(query, minlength=len(least)) == k)
    least = least.copy()
    least[full] = score[np.searchsorted(query, full, side="right") - 1]
    return least


def _closest(who: np.ndarray, asked: np.ndarray, ids: np.ndarray, held: np.ndarray, least: np.ndarray, apart: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, score), by position: of the rows with other ids those whose product is among the best ``k`` of a query and not below its ``least``, and maybe more."""
    rough = asked @ held.T
    if len(ids) > k and np.isneginf(least).any():
        others = np.where(who[:, None] == ids, -np.inf, rough)
        least = np.fmax(least, np.partition(others, -k, axis=1)[:, -k])
    query, row = np.divmod(np.flatnonzero(~(rough < (least - apart)[:, None])), len(ids))
    other = who[query] != ids[row]
    query, row = query[other], row[other]
    # each product is summed in one fixed order, so equal vectors tie exactly
    step = max(1, HELD // held.shape[1])
    score = [np.einsum("ij,ij->i", asked[query[i:i + step]], held[row[i:i + step]]) for i in range(0, len(query), step)]
    found = query, row, np.concatenate(score) if score else np.empty(0)
    return _cut([found], k) if len(query) > 2 * k * len(who) else found


def _cut(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """(query, row, score) of the best ``k`` of each query, in order; a pair counts once, of equal scores the first row."""
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    query, row, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((row, -score, query))
    order = order[np.isfinite(score[order])]
    query, row, score = query[order], row[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (row[1:] != row[:-1])
    query, row, score = query[new], row[new], score[new]
    first = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[first], row[first], score[first]


def _met(data: DataFrame, asked: DataFrame, k: int, dims: int) -> DataFrame:
    """The written (query_id, id, score): the best ``k`` rows of each block of each bucket for each query (bucket, id, vector) that asks the bucket."""
    sizes = written(data.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
                    .join(asked.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("turns")), "bucket"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = data.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("id"), "blocks").alias("block"), each("turns").alias("turn"), "id", "vector")
    queries = asked.join(sizes, "bucket").select("bucket", each("blocks").alias("block"), F.pmod(F.xxhash64("id"), "turns").alias("turn"), F.col("id").alias("asker"), F.col("vector").alias("asked"))
    return written(_best(members, queries, ["bucket", "block", "turn"], k, dims))


def _best(members: DataFrame, queries: DataFrame, key: list[str], k: int, dims: int) -> DataFrame:
    """(query_id, id, score): the best ``k`` members of each group for each of its queries."""

    def work(ids: np.ndarray, vectors: np.ndarray, who: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for first in range(0, len(who), 512):
            names, part = who[first:first + 512], asked[first:first + 512]
            query, row, score = _cut([_closest(names, part, ids, vectors, np.full(len(names), -np.inf), _apart(part, vectors), k)], k)
            yield names[query], ids[row], score

    return _grouped(members, queries, key, dims, work)


def _grouped(members: DataFrame, queries: DataFrame, key: list[str], dims: int, work: Callable[..., Iterator[tuple[np.ndarray, ...]]]) -> DataFrame:
    """(query_id, id, score) that ``work`` finds from the ids and vectors, in order of ids, of the members of each group and of its queries."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        got = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not len(held) or not len(asked):
            return got.empty_table()
        ids, vectors = np.asarray(held.column("id")), _matrix(held.column("vector").combine_chunks(), dims)
        order = np.argsort(ids, kind="stable")
        if len(np.unique(ids)) < len(ids):  # rows that are the same count as one
            order = np.array(list({(ids[i], (vectors[i] + 0.0).tobytes()): i for i in order}.values()))
        wanted = _matrix(asked.column("asked").combine_chunks(), dims)
        found = work(ids[order], vectors[order], np.asarray(asked.column("asker")), wanted)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(who), pa.array(row), pa.array(score + 0.0)], schema=got) for who, row, score in found], got)

    ship_package(members.sparkSession)
    return members.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(run, "query_id long, id long, score double")
