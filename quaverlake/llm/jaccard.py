"""Jaccard join of word shingle sets by a token-group matrix.

1. Documents with equal sets are one node. Nodes that share one of their smallest shingle names are compared with the first such node, then
   those that share a rare shingle with two nodes of other groups for each shingle: one by chance, and the one that shares most shingles. Nodes that link form groups of similar
   documents, in parts of bounded size. Each node is compared with a few others only, so a group of any size costs in proportion to it.
2. The matrix holds, for each group, the shingles of its members that a partner must share (the shortest beginnings, rare shingles first).
   A node asks for the groups that hold one of its own first shingles, groups of its own component left out: they are joined already.
3. For each such node and group, the node's overlap with the union of all the group's shingles bounds its similarity to every member. The
   union is a row of bits, one for each hash of a shingle: a shingle of the node whose bit isn't set is in no member. Only groups that pass
   are opened; their members are bounded in the same way, and those that pass are compared with the node shingle by shingle.

Every pair that links is in one component in the end, so components are exact; pairs within a component need no proof of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaverlake.llm import words
from quaverlake.llm.components import components
from quaverlake.llm.tables import map_batches, settled, sized, written

#: Shingle names are counted by their first 20 bits: a table of fixed size, whatever the corpus.
COUNT_BITS = 20
#: Bits in the row of a set: twice its size, within these bounds.
LEAST_BITS, MOST_BITS = 256, 1 << 15
#: Each node is compared with the first node that shares one of so many smallest shingles.
ANCHORS = 4
#: Members of a part of a group.
PART = 32
#: About so many nodes are compared with one part in one stretch of rows.
ASKING = 4096


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, shingles, bounds, sizes, node names) by slices; a node's name stands for its set."""
    for first, data, offsets in words.text_slices(column, 1 << 18):
        got, bounds = words.shingles(*words.words(data, offsets), n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(got + np.uint64(1)), dtype=np.uint64)))
        sizes = np.diff(bounds)
        nodes = words.mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64)).astype(np.int64)
        yield first, got, bounds, sizes, nodes


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int64)))


def _survey(docs: DataFrame, columns: list, n: int, id_kind: str) -> DataFrame:
    """Each row's id, text key, set size, node and smallest shingles; and for each task, counts of shingle names (rows with ``counts``)."""
    names = ["id", "key", "n", "node", "low", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, kind = np.zeros(1 << COUNT_BITS, np.int64), set(), None
        for batch in batches:
            kind = batch.column(0).type
            for first, got, bounds, sizes, nodes in _sets(batch.column(1), n):
                new = np.array([x not in seen and not seen.add(x) for x in nodes.tolist()], bool)
                total += np.bincount((got[np.repeat(new, sizes)] >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
                few = np.minimum(sizes, ANCHORS)
                at = np.concatenate(([0], np.cumsum(few)))
                low = got[np.arange(at[-1]) + np.repeat(bounds[:-1] - at[:-1], few)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(nodes)), batch.column(2).slice(first, len(nodes)), pa.array(sizes.astype(np.int64)),
                                                  pa.array(nodes, mask=sizes == 0), _lists(low, at), pa.nulls(len(nodes), pa.list_(pa.int64()))], names)
        if kind is not None:
            held = np.flatnonzero(total)
            counts = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array(held << 40 | total[held]))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.list_(pa.int64())), counts], names)

    return written(map_batches(docs, columns, work, f"id {id_kind}, key long, n long, node long, low array<long>, counts array<long>"))


def _levels(survey: DataFrame) -> np.ndarray:
    """How common the shingles of each first 16 bits are beyond what chance explains: 0 for most, then a step for each doubling."""
    bucket = F.shiftright("c", 40).cast("int")
    rows = survey.select(F.explode("counts").alias("c")).groupBy(bucket.alias("bucket")).agg(F.sum(F.col("c").bitwiseAND((1 << 40) - 1)).alias("c")).toArrow()
    counts = np.zeros(1 << COUNT_BITS)
    counts[np.asarray(rows.column("bucket"))] = np.asarray(rows.column("c"))
    mean = float(np.median(counts))
    least = mean + 3 * np.sqrt(mean) + 2
    over = np.log2(np.maximum((counts - mean) / (least - mean), 0.5))
    return np.where(counts > least, 1 + np.floor(np.maximum(over, 0)), 0).astype(np.int8)


def _first_shingles(docs: DataFrame, columns: list, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(token, node, n, index): the shingles of which two linked sets share one, rare ones first.

    Sets x and y link only if x holds ``percent`` % of y's size in common with it. So among the first ``|x| - ceil(t |x|) + 1`` shingles of
    both there is a common one; of the smaller set, the first ``|x| - ceil(2 t / (1 + t) |x|) + 1`` (``index``) are enough.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, got, bounds, sizes, nodes in _sets(batch.column(1), n):
                new = np.array([x not in seen and not seen.add(x) for x in nodes.tolist()], bool) & (sizes > 0)
                rows = words.row_of(bounds)
                keep = new[rows]
                got, rows = got[keep], rows[keep]
                level = levels[(got >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                order = np.argsort(rows * 64 + level, kind="stable")  # shingles ascend within a row, so ties do too
                got = got[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                size = sizes[rows]
                probe = place < size - (percent * size + 99) // 100 + 1
                index = place < size - (2 * percent * size + 99 + percent) // (100 + percent) + 1
                yield pa.RecordBatch.from_arrays([pa.array(got[probe].astype(np.int64)), pa.array(nodes[rows[probe]]), pa.array(size[probe].astype(np.int32)),
                                                  pa.array(index[probe])], ["token", "node", "n", "index"])

    return map_batches(docs, columns, work, "token long, node long, n int, index boolean")


def _members(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(node, set) for the nodes of a written table (node, key), one row each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, got, bounds, sizes, nodes in _sets(batch.column(1), n):
                new = np.array([x not in seen and not seen.add(x) for x in nodes.tolist()], bool) & (sizes > 0)
                at = np.concatenate(([0], np.cumsum(sizes[new])))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), _lists(got[np.repeat(new, sizes)], at)], ["node", "set"])

    got = map_batches(_texts_of(docs, wanted), ["key", "text"], work, "node long, set array<long>")
    return written(got.groupBy("node").agg(F.any_value("set").alias("set")))


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts (key, text) of nodes (node, key)."""
    return texts.join(sized(wanted.select("key")), "key", "left_semi")


def _bits(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(node, size, bits) for the nodes of a written table (node, key), one row each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, got, bounds, sizes, nodes in _sets(batch.column(1), n):
                new = [i for i, x in enumerate(nodes.tolist()) if sizes[i] and x not in seen and not seen.add(x)]
                rows = []
                for i in new:
                    width = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * sizes[i] - 1).bit_length()))
                    flags = np.zeros(width, np.uint8)
                    flags[(got[bounds[i]:bounds[i + 1]] & np.uint64(width - 1)).astype(np.int64)] = 1
                    rows.append(np.packbits(flags, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), pa.array(sizes[new].astype(np.int64)), pa.array(rows, pa.binary())], ["node", "size", "bits"])

    got = map_batches(_texts_of(docs, wanted), ["key", "text"], work, "node long, size long, bits binary")
    return written(got.groupBy("node").agg(F.any_value("size").alias("size"), F.any_value("bits").alias("bits")))


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A longer row of bits as one of ``size`` bytes."""
    while len(bits) > size:
        bits = bits[:len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def _spread(bits: np.ndarray, size: int) -> np.ndarray:
    """A shorter row of bits as one of ``size`` bytes that leaves nothing out."""
    return np.tile(bits, size // len(bits))


def _within_bound(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The ``keys`` of pairs (bits_a, size_a, bits_b, need) of which a may have ``need`` shingles in b."""
    schema = pairs.select(*keys).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, n, b, need in zip(*(batch.column(c).to_pylist() for c in ("bits_a", "size_a", "bits_b", "need")), strict=True):
                x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                size = min(len(x), len(y))
                outside = int(np.bitwise_count(_folded(x, size) & ~_folded(y, size)).sum())
                keep.append(n - outside >= need)
            yield batch.select(keys).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs, [*keys, "bits_a", "size_a", "bits_b", "need"], work, schema)


class _Part:
    """The members of a part of a group, by the width of their rows of bits, and the union of these."""

    def __init__(self, nodes: list[int], sizes: list[int], bits: list[bytes]):
        rows = [np.frombuffer(r, np.uint8) for r in bits]
        widest = max(map(len, rows))
        self.union = np.bitwise_or.reduce([_spread(r, widest) for r in rows])
        self.widths = []
        for width in sorted({len(r) for r in rows}):
            at = [i for i, r in enumerate(rows) if len(r) == width]
            self.widths.append((width, np.array([nodes[i] for i in at]), np.array([sizes[i] for i in at]), np.stack([rows[i] for i in at])))

    def near(self, bits: bytes, n: int, percent: int) -> list[int]:
        """The members that a set of ``n`` shingles and these bits may link with: first by the union, then by each member's bits, both ways."""
        mine = np.frombuffer(bits, np.uint8)
        size = min(len(mine), len(self.union))
        if n - int(np.bitwise_count(_folded(mine, size) & ~_folded(self.union, size)).sum()) < -(-percent * n // 100):
            return []
        found: list[int] = []
        for width, nodes, sizes, rows in self.widths:
            size = min(len(mine), width)
            x, y = _folded(mine, size), rows
            while y.shape[1] > size:
                y = y[:, :y.shape[1] // 2] | y[:, y.shape[1] // 2:]
            need = -(-percent * (sizes + n) // (100 + percent))
            fits = ((100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & (n - np.bitwise_count(x & ~y).sum(1, dtype=np.int64) >= need)
                    & (sizes - np.bitwise_count(y & ~x).sum(1, dtype=np.int64) >= need))
            found += nodes[fits].tolist()
        return found


def _opened(candidates: DataFrame, members: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The written (a, b) that may link, of nodes and the parts they ask for (a, root, part).

    A part and those who ask for it meet in one stretch of sorted rows, the members first, so no row stands for a pair: pairs are compared
    as rows of a matrix, and those that pass alone come out. A part that many ask for is given out to several stretches.
    """
    at = ["root", "part", "share"]
    shares = written(candidates.groupBy("root", "part").agg(F.ceil(F.count("*") / ASKING).alias("shares")))
    asks = (candidates.join(shares, ["root", "part"]).select("root", "part", F.pmod(F.xxhash64("a"), "shares").alias("share"), F.lit(1).alias("asks"), F.col("a").alias("node"))
            .join(sized(bits), "node"))
    held = (members.join(shares, ["root", "part"]).select("root", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"),
                                                          F.lit(0).alias("asks"), "node").join(sized(bits), "node"))
    rows = asks.unionByName(held).repartition(*at).sortWithinPartitions(*at, "asks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, part = None, [], None
        for batch in batches:
            out_a, out_b = [], []
            for *key, asking, node, size, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, waiting, part = key, [], None
                if not asking:
                    waiting.append((node, size, row))
                    continue
                if part is None and waiting:
                    part = _Part(*map(list, zip(*waiting, strict=True)))
                found = part.near(row, size, percent) if part else []
                out_a += [node] * len(found)
                out_b += found
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    got = map_batches(rows, [*at, "asks", "node", "size", "bits"], work, "a long, b long")
    return written(got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _asked(nodes: DataFrame, *ids: DataFrame) -> DataFrame:
    """The written (node, key) of the nodes that occur in any of the one-column frames."""
    found = ids[0].toDF("node")
    for more in ids[1:]:
        found = found.union(more.toDF("node"))
    return written(nodes.select("node", "key").join(found.distinct(), "node", "left_semi"))


def _linked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The written (a, b) that link: ``100 * common >= percent * union``. Bits are compared first, then sets."""
    bits = _bits(texts, n, _asked(nodes, pairs.select("a"), pairs.select("b")))
    both = (pairs.join(sized(bits.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"))), "a")
            .join(sized(bits.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))), "b"))
    need = F.ceil(percent * (F.col("size_a") + F.col("size_b")) / (100 + percent)).cast("long").alias("need")
    close = written(_within_bound(both.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")).select("a", "b", "bits_a", "size_a", "bits_b", need), ["a", "b"]))
    return _confirmed(close, texts, nodes, n, percent)


def _confirmed(close: DataFrame, texts: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The written pairs (a, b) of a written table whose sets link."""
    sets = _members(texts, n, _asked(nodes, close.select("a"), close.select("b")))
    common = F.size(F.array_intersect("sa", "sb"))
    met = close.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return written(met.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"))


def _mixed(shared: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows of shared shingles with the ``root`` of their node, of those shingles that several components hold."""
    by_token = Window.partitionBy("token")
    rooted = shared.join(sized(grouped), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.withColumn("lo", F.min("root").over(by_token)).withColumn("hi", F.max("root").over(by_token)).where("lo < hi").drop("lo", "hi")


def _stars(grouped: DataFrame) -> DataFrame:
    """The links of each component as (a, b) from its root to its nodes: what is joined already needs no more rounds."""
    return grouped.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) of every row: its set's size and the smallest id that it reaches by links.

    A row's set holds the distinct ``n``-word shingles of the whole text; a text of fewer words has them all as its one shingle; a text
    without words, or a null, has none, links with nothing and is its own component. Repeated rows and ids each count by their text; a null
    id is kept and never the smallest unless nothing else is reached (then null). An empty table gives no rows. Other columns aren't read.
    """
    id_kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    texts = docs.select(F.xxhash64(text).alias("key"), text)
    survey = _survey(docs, [F.col(f"`{id_col}`").alias("id"), text, F.xxhash64(text).alias("key")], n, id_kind)
    rows = survey.where("counts IS NULL").drop("counts")
    nodes = written(rows.where("n > 0").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("low").alias("low"), F.min("key").alias("key")))

    # groups: each node with the first node that shares one of its smallest shingles
    low = nodes.select("node", "n", F.explode("low").alias("token"))
    heads = low.groupBy("token").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("c")).where("c > 1")
    alike = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    near = written(low.join(heads, "token").select(F.col("node").alias("a"), F.col("head.node").alias("b"), "n", F.col("head.n").alias("m"))
                   .where((F.col("a") != F.col("b")) & alike).select("a", "b").distinct())
    links = _linked(near, texts, nodes, n, percent)

    settled(docs.sparkSession)
    # more groups: each node with two nodes for each first shingle that it shares beyond its group, one by chance and the one that shares most
    by_token = Window.partitionBy("token")
    first = _first_shingles(texts, ["key", "text"], n, percent, _levels(survey))
    shared = written(first.withColumn("lo", F.min("node").over(by_token)).withColumn("hi", F.max("node").over(by_token)).where("lo < hi").drop("lo", "hi"))
    grouped = written(components(links))
    mixed = written(_mixed(shared, grouped))
    ranked = mixed.join(sized(written(mixed.groupBy("node").agg(F.count("*").alias("shares")))), "node").withColumn("lot", F.xxhash64("token", "node"))
    drawn = ranked.groupBy("token").agg(F.array(F.min(F.struct("lot", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("of"))).getField("b"),
                                                F.max(F.struct("shares", "node")).getField("node")).alias("heads"))
    met = mixed.join(drawn, "token").select(F.col("node").alias("a"), "n", "root", F.explode(F.array_distinct("heads")).alias("b")).where("a <> b").distinct()
    beside = mixed.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("of")).distinct()
    near = met.join(beside, "b").where((F.col("root") != F.col("of")) & alike)
    links = _linked(written(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), texts, nodes, n, percent)
    grouped = written(components(_stars(grouped).union(links)))

    settled(docs.sparkSession)
    # the matrix: first shingles that more than one component holds
    mixed = written(_mixed(shared, grouped).distinct())
    sizes = grouped.groupBy("root").agg(F.count("*").alias("members"))
    parts = F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("members", F.lit(1)) / PART)).alias("part")
    touched = mixed.select("root").distinct()
    members = written(mixed.select("root", "node").union(grouped.join(touched, "root", "left_semi").select("root", "node")).distinct()
                      .join(sizes, "root", "left").select("root", "node", parts))
    matrix = (mixed.where("index").join(members, ["root", "node"]).groupBy("token", "root", "part").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    asked = mixed.select("token", F.col("node").alias("a"), F.col("root").alias("of"), F.col("n").alias("size"))
    candidates = written(asked.join(matrix, "token").where((F.col("of") != F.col("root")) & (F.col("least") <= F.col("size")) & (100 * F.col("most") >= percent * F.col("size")))
                         .select("a", "root", "part").distinct())
    open_to = written(members.join(candidates.select("root", "part").distinct(), ["root", "part"], "left_semi").select("root", "part", "node"))
    bits = _bits(texts, n, _asked(nodes, open_to.select("node"), candidates.select("a")))
    links = _confirmed(_opened(candidates, open_to, bits, percent), texts, nodes, n, percent)

    roots = written(components(_stars(grouped).union(links)))
    placed = rows.join(sized(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    return placed.join(least, "root", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                                                     F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
