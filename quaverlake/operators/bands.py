"""Distance, band and interval joins as equi-joins on grid cells.

Spark has no range join: an unkeyed band condition plans as a nested loop. A cell as wide as the
tolerance turns it into an equi-join in which one side is copied to its neighbouring cells, so a
row meets only rows closer than two cells. The page or document stays the first join key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(col: Column, width: float) -> Column:
    return F.floor(col / F.lit(width)).cast("bigint")


def _prefixed(right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    return renamed, [f"__r_{k}" for k in keys]


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_pos: str, right_pos: str,
              width: float, condition: Column, how: str = "inner") -> DataFrame:
    """Rows of one key whose positions differ by at most ``width`` and meet ``condition``.

    The right side is copied into three cells. ``condition`` names columns of both sides; it must
    imply ``abs(left_pos - right_pos) <= width``. ``how`` may be inner, left, left_semi, left_anti.
    """
    l = left.withColumn("__cell", cell(F.col(left_pos), width))
    r, rk = _prefixed(right, keys)
    r = r.withColumn("__rcell", F.explode(F.sequence(cell(F.col(right_pos), width) - 1,
                                                     cell(F.col(right_pos), width) + 1)))
    cond = (F.col("__cell") == F.col("__rcell")) & condition
    for k, a in zip(keys, rk):
        cond = (F.col(k) == F.col(a)) & cond
    return l.join(r, cond, how).drop("__cell", "__rcell", *rk)


def box_join(points: DataFrame, boxes: DataFrame, keys: Sequence[str], x: str, y: str,
             bounds: tuple[Column, Column, Column, Column], size: float, how: str = "inner") -> DataFrame:
    """Points inside boxes: a box is copied to every grid cell of ``size`` it touches.

    ``bounds`` is (x0, y0, x1, y1) as expressions of the boxes; bounds are inclusive.
    """
    x0, y0, x1, y1 = bounds
    r, rk = _prefixed(boxes.withColumn("__x0", x0).withColumn("__y0", y0)
                      .withColumn("__x1", x1).withColumn("__y1", y1), keys)
    r = (r.withColumn("__rx", F.explode(F.sequence(cell(F.col("__x0"), size), cell(F.col("__x1"), size))))
         .withColumn("__ry", F.explode(F.sequence(cell(F.col("__y0"), size), cell(F.col("__y1"), size)))))
    l = points.withColumn("__cx", cell(F.col(x), size)).withColumn("__cy", cell(F.col(y), size))
    cond = ((F.col("__cx") == F.col("__rx")) & (F.col("__cy") == F.col("__ry"))
            & F.col(x).between(F.col("__x0"), F.col("__x1")) & F.col(y).between(F.col("__y0"), F.col("__y1")))
    for k, a in zip(keys, rk):
        cond = (F.col(k) == F.col(a)) & cond
    return l.join(r, cond, how).drop("__cx", "__cy", "__rx", "__ry", "__x0", "__y0", "__x1", "__y1", *rk)


def stab_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: Column, end: Column,
              width: float, how: str = "inner", closed_right: bool = False) -> DataFrame:
    """Points against the intervals [start, end) (or [start, end]) that contain them.

    An interval is copied to each stretch of ``width`` it covers; a point lies in exactly one.
    """
    r, rk = _prefixed(intervals.withColumn("__s", start).withColumn("__e", end), keys)
    r = (r.filter(F.col("__e") >= F.col("__s"))
         .withColumn("__rc", F.explode(F.sequence(cell(F.col("__s"), width), cell(F.col("__e"), width)))))
    l = points.withColumn("__pc", cell(F.col(at), width))
    upper = F.col(at) <= F.col("__e") if closed_right else F.col(at) < F.col("__e")
    cond = (F.col("__pc") == F.col("__rc")) & (F.col(at) >= F.col("__s")) & upper
    for k, a in zip(keys, rk):
        cond = (F.col(k) == F.col(a)) & cond
    return l.join(r, cond, how).drop("__pc", "__rc", "__s", "__e", *rk)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lspan: tuple[Column, Column],
                 rspan: tuple[Column, Column], width: float, strict: bool = False,
                 also: tuple[tuple[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """Pairs of intervals (or, with ``also``, boxes) that overlap.

    Both sides are copied to the cells they touch; a pair is kept only in the first cell both
    touch, so it comes out once without a distinct.
    """
    def cells(df: DataFrame, span: tuple[Column, Column], tag: str) -> DataFrame:
        return (df.withColumn(f"__{tag}0", cell(span[0], width))
                .withColumn(f"__{tag}c", F.explode(F.sequence(cell(span[0], width), F.greatest(cell(span[0], width),
                                                                                           cell(span[1], width))))))

    r, rk = _prefixed(right, keys)
    l, r = cells(left, lspan, "l"), cells(r, rspan, "r")

    def meets(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        return ((a[0] < b[1]) & (b[0] < a[1])) if strict else ((a[0] <= b[1]) & (b[0] <= a[1]))

    cond = ((F.col("__lc") == F.col("__rc")) & (F.col("__lc") == F.greatest("__l0", "__r0")) & meets(lspan, rspan))
    if also is not None:
        cond = cond & meets(*also)
    for k, a in zip(keys, rk):
        cond = (F.col(k) == F.col(a)) & cond
    return l.join(r, cond).drop("__lc", "__rc", "__l0", "__r0", *rk)
