"""Order statistics, paging and top-n."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.operators.segments import for_long, running_sum
from quaverlake.session import cut_lineage

#: Slices per key in the two-level rank search, and the number of different values from which a key is sliced.
_SLICES, _SLICED_FROM = 64, 10_000


def select_ranks(df: DataFrame, keys: Sequence[str], value: str,
                 wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact values at 0-based ranks, one row per key.

    ``wanted`` maps an output name to the rank as an expression of the group size. Equal values
    are combined before the shuffle and each key of many values is cut into slices of about equally many, at
    approximate quantiles, so a key with a third of all rows is still counted in parallel, however
    its values are spread. Where no key has many values, plain windows do. NULL values are left out.

    Approximate quantiles come out differently when they are computed again, so a value's slice is written down before it is used.
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    counts = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__x"))
                         .agg(F.count(F.lit(1)).alias("__c")).withColumn("__k", key))
    if for_long(counts, keys, True, _SLICED_FROM):
        sizes = counts.groupBy("__k").agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__d"))
        cuts = (counts.join(sizes.filter(F.col("__d") > _SLICED_FROM), "__k", "left_semi").groupBy("__k")
                .agg(F.percentile_approx("__x", [i / _SLICES for i in range(1, _SLICES)], 1000).alias("__cuts")))
        place = F.size(F.filter("__cuts", lambda c: c < F.col("__x")))
        joined = cut_lineage(counts.join(sizes.join(cuts, "__k", "left"), "__k")
                             .select(*keys, "__x", "__c", "__n", F.when(F.col("__cuts").isNotNull(), place).otherwise(0).cast("bigint").alias("__slice")))
        run = running_sum(joined, keys, ["__x"], F.col("__c"), "__cum", F.col("__slice"))
    else:
        whole = W.partitionBy(*keys)
        run = (counts.withColumn("__cum", F.sum("__c").over(whole.orderBy("__x").rowsBetween(W.unboundedPreceding, W.currentRow)))
               .withColumn("__n", F.sum("__c").over(whole)))
    picks = []
    for name, rank in wanted.items():
        k = rank(F.col("__n"))
        picks.append(F.max(F.when((F.col("__cum") > k) & (F.col("__cum") - F.col("__c") <= k),
                                  F.col("__x"))).alias(name))
    return run.groupBy(*keys).agg(*picks)


def _nearest(fraction: float) -> Callable[[Column], Column]:
    return lambda n: F.least(n - 1, F.floor(F.lit(fraction) * n))


def percentile_rank(df: DataFrame, value: str, fraction: float, keys: Sequence[str] = (),
                    out: str = "value") -> DataFrame:
    """A-16: nearest rank at index ``floor(fraction * n)``, so the value really happened."""
    return select_ranks(df, keys, value, {out: _nearest(fraction)})


def percentile_ranks(df: DataFrame, value: str, fractions: dict[str, float],
                     keys: Sequence[str] = ()) -> DataFrame:
    """A-16 for several fractions in one pass."""
    return select_ranks(df, keys, value, {n: _nearest(f) for n, f in fractions.items()})


def upper_median(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "median") -> DataFrame:
    """A-33: the element at index ``n // 2`` of the sorted values."""
    return select_ranks(df, keys, value, {out: lambda n: F.floor(n / 2)})


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "median") -> DataFrame:
    """Median that averages the middle pair."""
    both = select_ranks(df, keys, value, {"__a": lambda n: F.floor((n - 1) / 2), "__b": lambda n: F.floor(n / 2)})
    return both.withColumn(out, (F.col("__a") + F.col("__b")) / 2.0).drop("__a", "__b")


def newest_first(df: DataFrame, col: str, tie: str) -> DataFrame:
    """T-01: newest first, NULL counted as 0, ties in key order."""
    return df.orderBy(F.coalesce(F.col(col), F.lit(0)).desc(), F.col(tie).asc())


Order = Sequence[tuple[Column, bool]]


def _sorted(order: Order) -> list[Column]:
    return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in order]


def _before(order: Order, bound: Sequence[object]) -> Column:
    """Whether a row comes before the row whose order values are ``bound``."""
    out, same = F.lit(False), F.lit(True)
    for (c, up), v in zip(order, bound):
        if up:
            less = F.lit(False) if v is None else c.isNull() | F.coalesce(c < F.lit(v), F.lit(False))
        else:
            less = c.isNotNull() if v is None else F.coalesce(c > F.lit(v), F.lit(False))
        out, same = out | (same & less), same & c.eqNullSafe(F.lit(v))
    return out


def rank_slice(df: DataFrame, order: Order, first: int, last: int, total: int, splits: int = 64, enough: int = 100_000) -> DataFrame:
    """The rows at places ``first`` to ``last`` (from 0, ``last`` not included) of the order, found by counts and not by sorting what comes before.

    ``order``: (column, ascending) pairs; NULLs come first ascending and last descending. A few sampled rows cut what is left of the list into
    ranges; one combined count of each says which of them the places lie in. Once these hold ``enough`` rows, or no more can be cut, they
    alone are sorted, and only up to the last place. The sample decides how many rounds that takes (the logarithm of the list to the base of
    ``splits``), never which rows come out.
    """
    low, high, skipped, left = None, None, 0, total
    names = [f"__o{i}" for i in range(len(order))]

    def inside(d: DataFrame) -> DataFrame:
        if low is not None:
            d = d.where(~_before(order, low))
        return d if high is None else d.where(_before(order, high))

    while left > enough:
        keys = inside(df).select(*[c.alias(n) for n, (c, _) in zip(names, order)])
        drawn = keys.sample(min(1.0, 20.0 * splits / left), seed=7).distinct()
        drawn = [tuple(r) for r in drawn.orderBy(*_sorted([(F.col(n), up) for n, (_, up) in zip(names, order)])).collect()]  # some thousands of rows at most
        bounds = [drawn[len(drawn) * i // splits] for i in range(splits) if drawn and len(drawn) * i // splits < len(drawn)]
        bounds = list(dict.fromkeys(bounds))
        if not bounds:
            break
        counts = [c or 0 for c in inside(df).agg(*[F.count_if(_before(order, b)) for b in bounds]).first()]
        below = max((i for i, c in enumerate(counts) if skipped + c <= first), default=None)
        above = min((i for i, c in enumerate(counts) if skipped + c >= last), default=None)
        new_low = low if below is None else bounds[below]
        new_high = high if above is None else bounds[above]
        kept = (counts[above] if above is not None else left) - (counts[below] if below is not None else 0)
        if kept >= left:
            break
        skipped += counts[below] if below is not None else 0
        low, high, left = new_low, new_high, kept
    return inside(df).orderBy(*_sorted(order)).offset(first - skipped).limit(last - first)


def paginate(df: DataFrame, order: Order, page: int, size: int, max_size: int) -> DataFrame:
    """W-01: one page of a list, with the total, the page count and the page really shown.

    ``size`` is clamped to ``max_size``, the page to the last one. However deep the page is, what comes before it is counted, not moved or sorted:
    see :func:`rank_slice`.
    """
    size = max(1, min(size, max_size))
    total = df.count()
    pages = max(1, -(-total // size))
    page = max(1, min(page, pages))
    rows = rank_slice(df, order, (page - 1) * size, min(page * size, max(total, 1)), total)
    return (rows.withColumn("total", F.lit(total).cast("bigint"))
            .withColumn("page", F.lit(page)).withColumn("pages", F.lit(pages))
            .withColumn("page_size", F.lit(size)))


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """W-02: the first ``n`` rows of each key. Spark cuts each key before the shuffle
    (WindowGroupLimit), so at most ``n`` rows per key and task travel."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
