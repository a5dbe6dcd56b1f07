"""One-to-one assignment by rounds of mutual minima (J-15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.session import cut_lineage


def greedy_assign(pairs: DataFrame, left: str, right: str, cost: Sequence[str],
                  keys: Sequence[str] = (), few: int = 0) -> DataFrame:
    """J-15: the pairs a greedy pass in order of ``cost`` would take.

    Costs are compared as a tuple together with both ids, so the order is total. In each round
    every pair that is the cheapest of both its members is taken and its members leave; the
    cheapest remaining pair always qualifies, so the rounds end with nothing left and the result
    equals the sequential greedy pass. Each round is two combined aggregates, whose results alone
    are joined, and two joins that drop the pairs of members that left. Copies of a pair come out
    once; pairs without a key or a member don't compete. With ``few``, rounds end where no more pairs are left:
    what they took is right, and a caller that makes the pairs of the members left goes on from there.
    """
    lk, rk = [*keys, left], [*keys, right]
    rank = F.struct(*cost, left, right, *[c for c in pairs.columns if c not in {*cost, *lk, *rk}])
    cheapest = lambda of: rest.groupBy(*of).agg(F.min(rank).alias("__rank")).select(*keys, "__rank.*")
    both = [*lk, right]
    for c in both:
        pairs = pairs.filter(F.col(c).isNotNull())
    rest, taken = cut_lineage(pairs), None
    while True:
        mutual = cut_lineage(cheapest(lk).join(cheapest(rk).select(*both), both).select(*pairs.columns))
        taken = mutual if taken is None else taken.unionByName(mutual)
        rest = cut_lineage(rest.join(mutual.select(*lk), lk, "left_anti")
                           .join(mutual.select(*rk), rk, "left_anti").select(*pairs.columns))
        if rest.count() <= few:
            return taken
