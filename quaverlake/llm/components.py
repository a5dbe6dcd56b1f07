"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.tables import written


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches; nodes without edges are left out.

    Large star and small star in turn, each a combined aggregate and a join, until nothing changes: rounds grow with the logarithm of the
    longest path, and rows with the edges. Each round ends in a table in the shared folder. Nulls join nothing; loops are no edges.
    """
    now = written(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
                  .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    state = _state(now)
    while state[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.where("m < u").select("u", F.col("m").alias("v")))  # no more rows than edges and nodes; repeated ones go with the small star's
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small)
        was, state = state, _state(now)
        if was == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and a sum that changes with them."""
    n, total = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return n, int(total)
