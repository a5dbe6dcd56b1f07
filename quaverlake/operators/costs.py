"""Daily and monthly cost summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.operators.ranks import top_n_per_key

SMALLEST_DAILY = 0.005
SMALLEST_MONTHLY = 0.01


def daily_cost(costs: DataFrame, top: int = 3) -> DataFrame:
    """A-17: cost per day, with its largest services as text in order."""
    kept = costs.filter(F.col("amount") >= SMALLEST_DAILY)
    days = costs.select("day").distinct()
    totals = kept.groupBy("day").agg(F.sum("amount").alias("total"))
    best = (top_n_per_key(kept, ["day"], [F.col("amount").desc(), F.col("service")], top)
            .groupBy("day").agg(*[F.max(F.when(F.col("rank") == i, F.col("service"))).alias(f"top{i}")
                                  for i in range(1, top + 1)]))
    return (days.join(totals, "day", "left").join(best, "day", "left")
            .withColumn("total", F.coalesce(F.col("total"), F.lit(0.0))))


def settled_average(daily: DataFrame) -> DataFrame:
    """A-17: the average of all days but the last, which is not complete yet."""
    last = daily.agg(F.max("day").alias("__last"))
    return (daily.join(F.broadcast(last), F.col("day") < F.col("__last"))
            .agg(F.avg("total").alias("average"), (F.avg("total") * 30.44).alias("per_month")))


def monthly_cost(costs: DataFrame, first_day: str, end_day: str) -> DataFrame:
    """A-18: cost per service over whole months [first_day, end_day), largest first, with the total.

    The total covers every service, also those too small to list.
    """
    span = costs.filter((F.col("day") >= F.lit(first_day).cast("date")) & (F.col("day") < F.lit(end_day).cast("date")))
    rolled = span.rollup("service").agg(F.sum("amount").alias("amount"), F.grouping("service").alias("is_total"))
    return (rolled.filter((F.col("is_total") == 1) | (F.col("amount") >= SMALLEST_MONTHLY))
            .select(F.when(F.col("is_total") == 1, "Total").otherwise(F.col("service")).alias("service"), "amount",
                    F.col("is_total").cast("int").alias("is_total"))
            .orderBy("is_total", F.col("amount").desc(), "service"))
