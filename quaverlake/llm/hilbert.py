"""Shards as runs of a Hilbert curve through quantised metadata: near rows in every dimension lie in the same shard, so files can be pruned by any.

The law of the shards is ``rows``: their counts are at most one apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.tables import map_batches, written


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (rows) with coordinates of ``bits`` bits each; dimensions times bits is 63 at most.

    Quadrants are undone from the coarsest bit down: each bit says whether the finer bits of the first axis are mirrored or trade places with
    another axis. What is left is a Gray code of the place.
    """
    axes = [cells[:, d].astype(np.uint64) for d in range(cells.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        top, finer = np.uint64(level), (one << np.uint64(level)) - one
        for d, axis in enumerate(axes):
            on = (axis >> top & one).astype(bool)
            trade = (axes[0] ^ axis) & finer
            axes[0] = np.where(on, axes[0] ^ finer, axes[0] ^ trade)
            if d:
                axes[d] = np.where(on, axis, axis ^ trade)
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    fold = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        fold = fold ^ np.where((axes[-1] >> np.uint64(level) & one).astype(bool), (one << np.uint64(level)) - one, np.uint64(0))
    place = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            place = place << one | ((axis ^ fold) >> np.uint64(level) & one)
    return place.astype(np.int64)


def quantised(df: DataFrame, column: str, bits: int) -> Column:
    """A cell of ``bits`` bits for a column, 0 for nulls: numbers by cut points that split the rows about evenly, other types by hash."""
    field = df.schema[column]
    name, top = F.col(f"`{column}`"), (1 << bits) - 1
    if field.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal", "date", "timestamp"):
        number = name.cast("double") if field.dataType.typeName() not in ("date", "timestamp") else F.unix_seconds(name.cast("timestamp")).cast("double")
        cuts = df.select(F.percentile_approx(number, [i / top for i in range(1, top)], 10_000).alias("c")).first()[0]
        if not cuts:
            return F.lit(0)
        inner = sorted({c for c in cuts if c == c})
        marks = F.array(*[F.lit(float(c)) for c in inner])
        return F.when(number.isNull() | F.isnan(number), 0).otherwise(F.least(F.lit(top), F.size(F.filter(marks, lambda c: c < number)) + 1))
    return F.when(name.isNull(), 0).otherwise(F.pmod(F.xxhash64(name.cast("string")), F.lit(top)) + 1)


def curve_shards(rows: DataFrame, key_col: str, cells: Sequence[Column], shards: int = 8, *, bits: int = 6) -> DataFrame:
    """``rows`` with ``curve`` (place on the curve), ``rank`` (over all rows, from 0), ``shard`` and ``slot`` (in the shard, from 0).

    Rows are sorted by curve place, then the key, then all their other values as a hash, by a range shuffle; ranks come from the counts of the
    sorted partitions, so no task holds more than its range and the hottest cell is split by key. Wholly equal rows are in any order.
    Shard s holds ranks ``ceil(s n / shards)`` up to the next: counts differ by one at most. ``rows`` should be narrow; texts stay behind.
    """
    width = len(cells)
    named = rows.withColumns({f"__cell{i}": c.cast("long") for i, c in enumerate(cells)})
    schema = rows.schema.add("curve", "long")
    names = [f"__cell{i}" for i in range(width)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.select(schema.names[:-1]).columns, pa.array(hilbert_index(grid, bits))], schema.names)

    placed = written(map_batches(named, [F.col(f"`{c}`") for c in named.columns], work, schema))
    order = ["curve", F.col(f"`{key_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])]
    in_order = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r[0], r[1]) for r in in_order.groupBy(part.alias("p")).count().collect())  # one row for each partition
    before, total = {}, 0
    for p, c in sizes:
        before[p] = total
        total += c
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]), part) if before else F.lit(0)
    ranked = in_order.withColumn("rank", start + place)
    shard = F.floor(F.col("rank") * shards / max(total, 1)) if total * shards < (1 << 50) else F.expr(f"(rank * {shards}L) div {total}L")
    first = F.ceil(F.col("shard").cast("decimal(38,0)") * total / shards).cast("long")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - first).drop("__id")


def document_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", by: Sequence[str] = ("lang", "source"), shards: int = 8, bits: int = 6) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, curve) of every row, along a curve through its size and the columns ``by``.

    A null text has size 1 and checksum 0; nulls in the other columns have cells of their own; repeated rows each have a slot; null ids come
    first in their cell; an empty table gives no rows. A column of ``by`` that isn't there is left out. ``grown_shard`` is null: the law is ``rows``.
    """
    have = [c for c in by if c in docs.columns]
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1).cast("long").alias("size"),
                         F.crc32(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"), *[F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(have)])
    narrow = written(narrow)
    cells = [quantised(narrow, "size", bits), *[quantised(narrow, f"by{i}", bits) for i in range(len(have))]]
    got = curve_shards(narrow, "id", cells, shards, bits=bits)
    return got.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, *, id_col: str = "doc_id") -> None:
    """Writes whole rows by shard in slot order, one folder for each shard; ids must be unique and not null. A reader prunes files by their statistics."""
    rows = docs.join(placed.select(F.col(id_col), "shard", "slot"), id_col)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
