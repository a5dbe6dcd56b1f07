"""Ordered scans over keys of any size.

A plain window runs a whole key in one task, so a key holding a third of the rows would decide
the run time of the job. These operators split every key into chunks by a monotone expression of
the order, reduce each chunk with a map-side combined aggregate, run the window over the (few)
chunk summaries, and finish inside each chunk with the carried-in value. No task sees more than
one chunk of rows or one key's chunk summaries. ``chunk=None`` gives the plain window, for keys
that are bounded by their meaning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.session import cut_lineage

_KEY, _CHUNK, _CARRY = "__key", "__chunk", "__carry"
#: Rows of one key that a plain window may take in one task, and the buckets in which keys are first counted.
PLAIN_ROWS, _BUCKETS = 250_000, 1 << 14


def chunk_of(col: str | Column, width: float) -> Column:
    """A chunk number from a numeric order column: ``width`` is the chunk's length in its units."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col / F.lit(width)).cast("bigint")


def for_long(df: DataFrame, keys: Sequence[str], chunk, most: int = PLAIN_ROWS):
    """``chunk`` (a column or a width) if some key has more than ``most`` rows, else None: where no key is long, a chunk's summary is as large as
    the rows it stands for, and a plain window gives the same result with one exchange. Keys are counted in buckets first, which moves next to
    nothing, and only those of too full buckets by themselves."""
    bucket = F.pmod(F.xxhash64(*(keys or [F.lit(0)])), F.lit(_BUCKETS))
    full = [r[0] for r in df.groupBy(bucket.alias("b")).count().where(F.col("count") > most).collect()]
    long = full and not df.where(bucket.isin(full)).groupBy(*keys).count().where(F.col("count") > most).isEmpty()
    return chunk if long else None


def _order(order: Sequence[str], reverse: bool = False) -> list[Column]:
    return [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in order]


def _cut(df: DataFrame, keys: Sequence[str], chunk: Column, value: Column) -> DataFrame:
    """Rows with their value, and the key and chunk as structs: a struct is never NULL, and equal structs may hold NULLs, so plain equality
    serves keys that may be missing, and the join and the window that follows it need one and the same partitioning."""
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    return df.withColumn(_KEY, key).withColumn(_CHUNK, F.struct(chunk.alias("c"))).withColumn("__v", value)


def _attach(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Join chunk summaries back."""
    return df.join(summary.select(_KEY, _CHUNK, _CARRY), [_KEY, _CHUNK], "left")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                chunk: Column | None = None, inclusive: bool = True) -> DataFrame:
    """Sum of ``value`` over the rows up to this one (or before it, when not inclusive)."""
    end = W.currentRow if inclusive else -1
    if chunk is None:
        w = W.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(W.unboundedPreceding, end)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    src = _cut(df, keys, chunk, value)
    before = W.partitionBy(_KEY).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    totals = (src.groupBy(_KEY, _CHUNK).agg(F.sum("__v").alias("__t"))
              .withColumn(_CARRY, F.coalesce(F.sum("__t").over(before), F.lit(0))))
    inside = (W.partitionBy(_KEY, _CHUNK).orderBy(*_order(order)).rowsBetween(W.unboundedPreceding, end))
    return (_attach(src, totals)
            .withColumn(out, F.col(_CARRY) + F.coalesce(F.sum("__v").over(inside), F.lit(0)))
            .drop(_KEY, _CHUNK, _CARRY, "__v"))


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
              chunk: Column | None = None) -> DataFrame:
    """1-based position inside the key."""
    if chunk is None:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*_order(order))).cast("bigint"))
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, chunk)


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
               chunk: Column | None = None, inclusive: bool = True) -> DataFrame:
    """Last non-NULL ``value`` at or before this row (before it, when not inclusive)."""
    end = W.currentRow if inclusive else -1
    if chunk is None:
        w = W.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(W.unboundedPreceding, end)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    src = _cut(df, keys, chunk, value)
    before = W.partitionBy(_KEY).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    position = F.when(F.col("__v").isNotNull(), F.struct(*[F.col(c) for c in order]))
    lasts = (src.groupBy(_KEY, _CHUNK).agg(F.max_by("__v", position).alias("__t"))
             .withColumn(_CARRY, F.last("__t", ignorenulls=True).over(before)))
    inside = W.partitionBy(_KEY, _CHUNK).orderBy(*_order(order)).rowsBetween(W.unboundedPreceding, end)
    return (_attach(src, lasts)
            .withColumn(out, F.coalesce(F.last("__v", ignorenulls=True).over(inside), F.col(_CARRY)))
            .drop(_KEY, _CHUNK, _CARRY, "__v"))


def carry_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
               chunk: Column | None = None, inclusive: bool = False) -> DataFrame:
    """First non-NULL ``value`` after this row (or at it, when inclusive)."""
    start = W.currentRow if inclusive else 1
    if chunk is None:
        w = W.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(start, W.unboundedFollowing)
        return df.withColumn(out, F.first(value, ignorenulls=True).over(w))
    src = _cut(df, keys, chunk, value)
    after = W.partitionBy(_KEY).orderBy(_CHUNK).rowsBetween(1, W.unboundedFollowing)
    position = F.when(F.col("__v").isNotNull(), F.struct(*[F.col(c) for c in order]))
    firsts = (src.groupBy(_KEY, _CHUNK).agg(F.min_by("__v", position).alias("__t"))
              .withColumn(_CARRY, F.first("__t", ignorenulls=True).over(after)))
    inside = W.partitionBy(_KEY, _CHUNK).orderBy(*_order(order)).rowsBetween(start, W.unboundedFollowing)
    return (_attach(src, firsts)
            .withColumn(out, F.coalesce(F.first("__v", ignorenulls=True).over(inside), F.col(_CARRY)))
            .drop(_KEY, _CHUNK, _CARRY, "__v"))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, str | Column],
             chunk: Column | None = None) -> DataFrame:
    """Columns of the row before this one, as ``{new name: column}``."""
    return _neighbour(df, keys, order, cols, chunk, carry_last)


def following(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, str | Column],
              chunk: Column | None = None) -> DataFrame:
    """Columns of the row after this one, as ``{new name: column}``."""
    return _neighbour(df, keys, order, cols, chunk, carry_next)


def _neighbour(df, keys, order, cols, chunk, scan):
    packed = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])
    out = scan(df, keys, order, packed, "__nb", chunk, inclusive=False)
    return out.select("*", *[F.col(f"__nb.{n}").alias(n) for n in cols]).drop("__nb")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], new_group: Column, out: str,
            chunk: Column | None = None) -> DataFrame:
    """W-04: number the runs of rows; ``new_group`` is true on a run's first row."""
    return running_sum(df, keys, order, F.when(new_group, 1).otherwise(0).cast("bigint"), out, chunk)


def gap_islands(df: DataFrame, keys: Sequence[str], position: str, gap: Column | float, out: str,
                ties: Sequence[str] = (), chunk: Column | None = None) -> DataFrame:
    """W-04: a new run starts where the step from the previous row exceeds ``gap``."""
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    order = [position, *ties]
    stepped = previous(df, keys, order, {"__prev": position}, chunk)
    starts = F.col("__prev").isNull() | ((F.col(position) - F.col("__prev")) > gap)
    return islands(stepped, keys, order, starts, out, chunk).drop("__prev")


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                chunk: Column | None = None) -> DataFrame:
    """Largest ``value`` up to and including this row."""
    return _running_extreme(df, keys, order, value, out, chunk, F.max, F.greatest)


def running_min(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                chunk: Column | None = None) -> DataFrame:
    """Smallest ``value`` up to and including this row."""
    return _running_extreme(df, keys, order, value, out, chunk, F.min, F.least)


def _running_extreme(df, keys, order, value, out, chunk, agg, pick):
    if chunk is None:
        w = W.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumn(out, agg(value).over(w))
    src = _cut(df, keys, chunk, value)
    before = W.partitionBy(_KEY).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    best = (src.groupBy(_KEY, _CHUNK).agg(agg("__v").alias("__t"))
            .withColumn(_CARRY, agg("__t").over(before)))
    inside = (W.partitionBy(_KEY, _CHUNK).orderBy(*_order(order))
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    return (_attach(src, best).withColumn(out, pick(agg("__v").over(inside), F.col(_CARRY)))
            .drop(_KEY, _CHUNK, _CARRY, "__v"))


def with_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Aggregates of the key on every row, by a combined aggregate and a join instead of a
    whole-key window."""
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    renamed = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *aggs)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return df.join(renamed, cond, "left").drop(*[f"__k_{k}" for k in keys])


def settle(df: DataFrame, chunk: Column | None) -> DataFrame:
    """Write an intermediate result between chained chunked scans.

    A chunked scan reads its input twice (summary and rows), so a chain of them would recompute its
    start again and again; plain windows need no such cut.
    """
    return df if chunk is None else cut_lineage(df)
