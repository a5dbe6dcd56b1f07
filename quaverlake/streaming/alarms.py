"""Threshold alarms and metrics read from log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.operators.segments import islands, previous, row_index

STATISTICS = {"Maximum": F.max, "Minimum": F.min, "Sum": F.sum, "Average": F.avg}


def _breaches(value: Column, op: str, threshold: float) -> Column:
    return {"GreaterThanThreshold": value > threshold, "GreaterThanOrEqualToThreshold": value >= threshold,
            "LessThanThreshold": value < threshold, "LessThanOrEqualToThreshold": value <= threshold}[op]


def period_values(metrics: DataFrame, statistic: str, period_seconds: int, watermark: str | None = None,
                  keys: Sequence[str] = ("dimension",)) -> DataFrame:
    """ST-09, first half, batch or stream: the statistic of every fixed period (``at`` is a timestamp)."""
    m = metrics.withWatermark("at", watermark) if watermark else metrics
    per = m.groupBy(F.window("at", f"{period_seconds} seconds").alias("w"), *keys).agg(STATISTICS[statistic]("value").alias("value"))
    return per.select(*keys, (F.unix_seconds("w.start") / period_seconds).cast("bigint").alias("period"), "value")


def alarms(periods: DataFrame, op: str, threshold: float, evaluation_periods: int, keys: Sequence[str] = ("dimension",),
           chunk_periods: int = 1024) -> DataFrame:
    """ST-09, second half, over closed periods: periods in alarm: the last ``evaluation_periods`` periods all
    breach. A period without data is fine, so a gap ends a run."""
    chunk = F.floor(F.col("period") / chunk_periods).cast("bigint")
    bad = periods.filter(_breaches(F.col("value"), op, threshold))
    bad = previous(bad, keys, ["period"], {"__p": "period"}, chunk)
    runs = islands(bad, keys, ["period"], F.col("__p").isNull() | (F.col("period") != F.col("__p") + 1), "__run", chunk)
    if evaluation_periods > 1:
        runs = row_index(runs, [*keys, "__run"], ["period"], "__n", chunk).filter(F.col("__n") >= evaluation_periods).drop("__n")
    return runs.drop("__p", "__run")


def alarm_changes(in_alarm: DataFrame, keys: Sequence[str] = ("dimension",), chunk_periods: int = 1024) -> DataFrame:
    """When alarms go off and are over, as (first, last) period of every run in alarm."""
    chunk = F.floor(F.col("period") / chunk_periods).cast("bigint")
    a = previous(in_alarm, keys, ["period"], {"__p": "period"}, chunk)
    runs = islands(a, keys, ["period"], F.col("__p").isNull() | (F.col("period") != F.col("__p") + 1), "__run", chunk)
    return runs.groupBy(*keys, "__run").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"),
                                            F.max("value").alias("worst")).drop("__run")


def log_metric(lines: DataFrame, path: str, text: str = "value", out: str = "metric") -> DataFrame:
    """ST-10: lines whose JSON has a field at ``path``, with its number. Batch or stream."""
    number = F.get_json_object(F.col(text), path)
    return lines.withColumn(out, number.try_cast("double")).filter(F.col(out).isNotNull())
